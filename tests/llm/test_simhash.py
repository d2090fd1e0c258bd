import random
import re

import xxhash
from pyspark.sql import types as T

from placeforge.llm import simhash as S

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (id, fingerprint); all pairs, by flooding."""
    ids = list(range(len(rows)))
    comp = {}
    for i in ids:
        if i in comp:
            continue
        comp[i], todo = i, [i]
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in comp and (rows[x][1] ^ rows[y][1]).bit_count() <= 4:
                    comp[y] = i
                    todo.append(y)
    least = {}
    for i, c in comp.items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return [(rows[i][0], f"{rows[i][1]:016x}", least.get(comp[i])) for i in ids]


def near_texts(n, seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 80))] for _ in range(12)]
    out = []
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out


def test_fingerprint_is_the_plain_one():
    rng = random.Random(1)
    for text in [None, "", " \t\n", "One", "a B c", "É É É x Y", "\x1c a b c d e", *near_texts(40, 2)]:
        assert S.fingerprint(text) == plain_fingerprint(text)
    long = " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(70_000))
    assert S.fingerprint(long) == plain_fingerprint(long)


def test_lower_bound():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ np.uint64(3)
    got = S.manhattan(S._vector(x), S._vector(y))
    want = [sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2)) for a, b in zip(x.tolist(), y.tolist())]
    assert got.tolist() == want
    assert (got <= np.bitwise_count(x ^ y)).all()


def test_components_against_all_pairs(spark):
    texts = near_texts(150, 3) + [None, "", "", "x", "x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "again the same id"), (None, "x"), (None, "alone here")]
    random.Random(4).shuffle(rows)
    docs = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, fingerprint string, component_id int")
    want = sorted(plain_components([(i, plain_fingerprint(t)) for i, t in rows]), key=str)
    for cell_rows in (4096, 3):
        got = [(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs, cell_rows=cell_rows).collect()]
        assert sorted(got, key=str) == want


def test_links_of_close_fingerprints(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(25)]
    fps = set(base)
    for b in base:
        for _ in range(8):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    for groups in (6, 7):
        edges = S.links(frame, groups=groups)
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in edges.collect())
        roots = {r.id: r.root for r in S.components(edges).collect()}
        classes = {}
        for x in fps:
            s = S._signed(x)
            classes.setdefault(roots.get(s, s), set()).add(x)
        want = {}
        for i, _, c in plain_components([(x, x) for x in fps]):
            want.setdefault(c, set()).add(i)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_empty_table(spark):
    out = S.near_duplicates(spark.createDataFrame([], DOCS))
    assert out.columns[:3] == ["doc_id", "fingerprint", "component_id"] and out.count() == 0
