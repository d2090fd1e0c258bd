"""Near copies of the pipeline's stage against all pairs."""

import random

import corpus_pipeline as C
import numpy as np
from placeforge.llm import nearcopies as N

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = (text or "").split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def similar(x, y):
    return x == y or len(x & y) * 5 >= len(x | y) * 4


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_stage_keeps_one_of_each_component_of_all_pairs(spark):
    rng = random.Random(4)
    line = [f"license{k}" for k in range(12)]
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 250))]
        texts += [words, edited(rng, words, len(words) // 70 + 1), edited(rng, words, len(words) // 45), words + line]
    large = [f"v{k}" for k in range(150)]
    texts += [edited(rng, large, 1) for _ in range(80)]
    rng.shuffle(texts)
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)] + [(3, "another text of this one id altogether"), (5000, None), (5001, ""), (None, " ".join(large))]
    rows += [rows[0]]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    own = [(i, t, plain_set(t)) for i, t in dict.fromkeys(rows) if i is not None]
    root = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if similar(own[i][2], own[j][2]) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    groups = {}
    for r, (i, t, _) in zip(root, own, strict=True):
        groups.setdefault(r, []).append((i, t))
    got = C.one_of_near_copies(spark, docs, "").collect()
    left = [(r.doc_id, r.text) for r in got if r.doc_id is not None]
    assert sorted(i for i, _ in left) == sorted(min(i for i, _ in g) for g in groups.values())
    assert sum(i == 3 for i, _ in left) >= 1 and (3, "another text of this one id altogether") in left
    assert sum(r.doc_id is None for r in got) == 1


def test_the_pipeline_uses_it():
    assert dict(C.STAGES)["near_duplicates"] is C.one_of_near_copies


def test_sketches_never_part_similar_sets():
    from placeforge.llm import nearcopies as N

    rng = random.Random(6)
    apart = 0
    for _ in range(400):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(5, 300))]
        x, y = N.shingles(" ".join(words)), N.shingles(" ".join(edited(rng, words, rng.randint(0, 6)) + ["more"] * rng.randint(0, 20)))
        near = len(set(x.tolist()) & set(y.tolist())) * 5 >= len(set(x.tolist()) | set(y.tolist())) * 4
        may = N.may_be_similar(N.sketch(x), N.sketch(y), len(x), len(y))
        assert may or not near
        apart += not may
    assert apart > 50


def test_brief_sketches_leave_out_no_similar_pair_and_few_others():
    """Sets at the least similarity never differ in more places than allowed; sets that share a passage mostly do."""
    rng = np.random.default_rng(11)
    differ = lambda x, y: int(np.bitwise_count((np.array(N.brief(x)) ^ np.array(N.brief(y))).view(np.uint64)).sum()) * (N.NUM + N.DEN)
    left = 0
    for n in (1, 5, 64, 300, 900):
        for _ in range(20):
            both = rng.integers(0, 2**64, n, np.uint64, endpoint=False)
            x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**64, n // 8, np.uint64)])) for _ in "xy")
            assert differ(x, y) <= (len(x) + len(y)) * (N.DEN - N.NUM)
            z = np.unique(np.concatenate([both[: n // 3], rng.integers(0, 2**64, n, np.uint64)]))
            left += differ(x, z) <= (len(x) + len(z)) * (N.DEN - N.NUM)
    assert left < 5
    assert N.brief(np.zeros(0, np.uint64)) == [0] * (N.BRIEF // 64)


def test_a_group_within_nearly_similar_texts_does_not_cost_its_square(spark, monkeypatch):
    """150 near copies among 900 texts that share most shingles with them but are less similar."""
    rng = random.Random(12)
    base = [f"b{k}" for k in range(150)]
    inner = edited(rng, base, 5)
    texts = list(dict.fromkeys(" ".join(x) for x in [*(edited(rng, base, 5) for _ in range(900)), *(edited(rng, inner, 1) for _ in range(150))]))
    tested, verify = [], N._verified

    def counted(pairs, *rest):
        tested.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(N, "_verified", counted)
    of_class, of_component = N.near_copies(spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(3))
    own, root = [plain_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(own)):
        for j in range(i):
            if root[i] != root[j] and similar(own[i], own[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    component = {r["class"]: r.component for r in of_component.collect()}
    got = {r.key: component.get(r["class"], r["class"]) for r in of_class.collect()}
    assert len({(got[k], root[k]) for k in got}) == len(set(root)) == len(set(got.values()))
    assert tested[-1] < 100 and sum(tested) < 12 * len(texts), tested  # all pairs that leaders have left: last


def test_runs_of_least_shingles():
    rng = np.random.default_rng(3)
    same = []
    for _ in range(200):
        both = rng.integers(0, 2**64, 300, np.uint64, endpoint=False)
        x, y = (N.least(np.unique(np.concatenate([both, rng.integers(0, 2**64, 20, np.uint64)]))) for _ in "xy")
        same.append([a == b for a, b in zip(x, y, strict=True)])
    for (_, n), share in zip(N.RUNS, np.mean(same, axis=0), strict=True):
        assert abs(share - (300 / 340) ** n) < 0.15
    assert N.least(both[:0]) == [] and len(set(N.least(both[:1]))) == len(N.RUNS)
