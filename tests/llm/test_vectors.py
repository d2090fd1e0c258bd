import math

import numpy as np
import pytest

from placeforge.llm import mtree, pstable

SCHEMA = "vec_id long, embedding array<float>, label int, v string, score int"


def rows_of(n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n - copies :] = x[0]
    return [(i, v.tolist()) for i, v in enumerate(x)]


ODD = [(9001, None), (9002, [0.0] * 8), (9003, [1.0] * 7 + [math.nan]), (9004, [1.0] * 7 + [math.inf]), (9005, [1.0] * 7 + [None]), (9006, []), (None, [1.0] * 8), (9020, [1.0, 2.0, 3.0]), (9021, [3.0, 2.0, 1.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", 2) for i, v in rows], SCHEMA)


def plain(rows, every, k, score, zero):
    """All pairs, one after another."""
    good = [(i, v) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v))]
    out = {}
    for q, a in good:
        if q % every == 0:
            found = {}
            for i, b in good:
                if i != q and len(a) == len(b):
                    s = score(a, b)
                    found[i] = max(found.get(i, s), s)
            out[q] = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]
    return {q: v for q, v in out.items() if v}


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_templates_order_and_validity():
    got = pstable.templates(4, 20)
    assert got[0] == () and got[1] == (0,) and len(set(got)) == 20
    for ranks in got:
        assert len({min(r, 7 - r) for r in ranks}) == len(ranks)


def test_search_with_full_scan_is_exact(spark, monkeypatch):
    monkeypatch.setattr(pstable, "CHOICES", ((1, 1e9),))
    rows = rows_of(300, 8, 1, copies=60) + ODD + [(5, rows_of(300, 8, 1)[5][1])]
    dot = lambda a, b: float((np.array(a, np.float32).astype(float) * np.array(b, np.float32).astype(float)).sum())
    want = plain(rows, 20, 20, dot, zero=False)
    data = frame(spark, rows)
    for unit_rows in (8192, 40):
        got = lists(pstable.search(data, data.where("vec_id % 20 = 0"), 20, unit_rows=unit_rows))
        assert got.keys() == want.keys()
        for q in want:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
            assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_recall_is_at_least_nine_tenths(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    x = np.concatenate([c + 0.3 * rng.standard_normal((60, 16)) for c in centres] + [rng.standard_normal((1200, 16))])
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    data = frame(spark, rows)
    got = lists(pstable.search(data, data.where("vec_id % 20 = 0"), 20))
    y = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 3000, 20):
        s = y @ y[q]
        s[q] = -np.inf
        hits += len({i for i, _ in got[q]} & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 150 * 20


def test_tree_search_is_exact(spark):
    rows = rows_of(700, 8, 3, copies=90) + ODD + [(7, rows_of(700, 8, 3)[7][1]), (9100, [1e6] * 8), (9150, [-3e5] * 8)]
    whole = lambda v: [math.floor(256 * float(np.float32(c))) for c in v]
    want = plain(rows, 50, 5, lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b), strict=True)), zero=True)
    data = frame(spark, rows)
    for tree_rows, page_rows in ((8192, 64), (100, 7), (40, 16)):
        got = lists(mtree.search(data, data.where("vec_id % 50 = 0"), 5, tree_rows=tree_rows, page_rows=page_rows))
        assert got == want


def test_bounds_save_distances():
    rng = np.random.default_rng(5)
    x = np.concatenate([10 * c + rng.standard_normal((50, 4)) for c in rng.standard_normal((40, 4))])
    pages = mtree.build(np.arange(len(x)), np.floor(256 * x).astype(np.int64), 32)
    best, count = mtree.walk(pages, np.arange(5) + 10**6, np.floor(256 * x[:5] + 3).astype(np.int64), 5)
    assert count < 0.7 * 5 * len(x)
    y = np.floor(256 * x).astype(np.int64)
    for k in range(5):
        s = y @ np.floor(256 * x[k] + 3).astype(np.int64)
        assert sorted(s)[::-1][:5] == best[k][0].tolist()


def test_clustered_queries_leave_trees_out(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 8))
    centres /= np.sqrt((centres**2).sum(axis=1))[:, None]
    x = np.concatenate([8 * c + 0.05 * rng.standard_normal((100, 8)) for c in centres])[rng.permutation(2000)]
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    data = frame(spark, rows)
    want = plain(rows, 50, 5, lambda a, b: int(sum(math.floor(256 * float(np.float32(p))) * math.floor(256 * float(np.float32(q))) for p, q in zip(a, b, strict=True))), zero=True)
    assert lists(mtree.search(data, data.where("vec_id % 50 = 0"), 5, tree_rows=100, page_rows=20)) == want
    pages, spaces = mtree.index(data, 100, 20)
    regions = mtree.regions_of(pages)
    trees = sum(n for _, n in regions[8].values())
    fifth = {q: v[-1][1] for q, v in want.items()}
    asked = spark.createDataFrame([(8, q, x[q].astype(np.float32).astype(float).tolist(), fifth[q]) for q in fifth], "dim int, qid long, v array<double>, least long")
    assert mtree.visits(asked, spaces, regions, first=False).count() < 0.2 * trees * len(fifth)
    assert trees >= 15


def test_one_id_with_many_vectors_hides_no_other(spark):
    near = [(700, [10.0 + k / 100, 0.0]) for k in range(60)]
    rows = [(0, [1.0, 0.0]), *[(k, [k / 10, 1.0]) for k in range(1, 12)], *near]
    want = plain(rows, 50, 5, lambda a, b: sum(math.floor(256 * float(np.float32(p))) * math.floor(256 * float(np.float32(q))) for p, q in zip(a, b, strict=True)), zero=True)
    data = frame(spark, rows)
    assert lists(mtree.search(data, data.where("vec_id % 50 = 0"), 5)) == want


def test_empty(spark):
    data = frame(spark, [])
    assert pstable.search(data, data).count() == 0
    assert mtree.search(data, data).count() == 0


def test_repeated_rows_take_no_neighbours_place(spark, monkeypatch):
    monkeypatch.setattr(pstable, "CHOICES", ((1, 1e9),))
    once = rows_of(120, 8, 8)
    # every row five times, and one id with 30 different vectors near the query
    near = [(700, (np.array(once[0][1]) * (2 + k / 100)).tolist()) for k in range(30)]
    dot = lambda a, b: float((np.array(a, np.float32).astype(float) * np.array(b, np.float32).astype(float)).sum())
    want = plain(once + near, 20, 20, dot, zero=False)
    data = frame(spark, once * 5 + near)
    got = lists(pstable.search(data, data.where("vec_id % 20 = 0"), 20))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
