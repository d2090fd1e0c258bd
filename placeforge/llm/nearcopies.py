"""Near copies by the exact Jaccard similarity of word shingles, SimHash first.

1. A text becomes the set of its 5-word shingles' XXH64, and the SimHash of that
   set; texts of equal sets are one class, so copies cost nothing further on.
2. SimHash links (fingerprints at 4 or fewer differing bits, found by
   ``simhash.links``) are verified by the sets.  At a similarity of 0.8 most
   fingerprints differ by more bits than any grid can bridge, so:
3. The shingles have one order for the whole corpus, rare ones first.  Sets of
   similarity 0.8 or more share a shingle among the first fifth of each (prefix
   filter), so no pair at 0.8 or more is lost, whatever the order.  The order:
   shingles of the least ``SHARE`` of hashes by the number of documents that hold
   them, which is counted over the whole corpus, then the others.  Shingles that
   only one document holds meet nothing and go no further.
4. Few of these pairs need a test.  Similar sets mostly have the least shingles of
   some orders in common (MinHash): each class is tested against the leaders of
   its runs of least shingles (``RUNS``: long ones part what is similar from what
   is nearly so), in rounds with other leaders for as long as that links many.
   Then all pairs of 3 that meet and are not yet in one component are tested.  A
   large group of near copies costs about its size and not its square.  Components
   go on as stars, so that no round sees an earlier one's links again.
5. Pairs whose sketches differ in more places than such sets can are left out,
   by sketches of fixed size (``BRIEF`` bits) where all pairs of a shingle meet;
   the others are tested by their sets, and links have 0.8 or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeforge.llm.common import drop_table, join_by_count, materialise, words_of
from placeforge.llm.simhash import SEED, components, links, majority

SHINGLE = 5
#: The least similarity of near copies: NUM of DEN.
NUM, DEN = 4, 5
#: Share of the hashes whose documents are counted; hashes counted by one task; a chunk closes at so many characters.
SHARE, PART_HASHES, CHUNK_CHARS = 0.3, 4_000_000, 40_000_000
#: Factors that make an order of shingles each; runs of orders, by start and length.
ORDERS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0xE7037ED1A0B428DB], np.uint64)
RUNS = [(a, n) for n in (1, 3, 6) for a in (0, 2, 4, 6)]
#: Rounds of leaders, at most; they end when under one in so many pairs that sketches allow is a link.
ROUNDS, WORTH = 6, 2
#: Bits of the sketches that go with the classes to where all pairs of a shingle meet.
BRIEF = 512
#: Bits of the filter over keys before a join.
KEY_BITS = 1 << 22
_LIMIT = np.uint64(int(SHARE * 2**64))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the text's shingles; a shorter text is one shingle, one without words none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    parts = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n))


def prefix_size(n: int) -> int:
    """How many of a set's first shingles one of any similar set must be among."""
    return n - -(-NUM * n // DEN) + 1 if n else 0


def stored(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted set: the shingles that are counted, and as many others as its prefix may need."""
    cut = int(np.searchsorted(own, _LIMIT))
    return own[:cut], own[cut : cut + max(0, prefix_size(len(own)) - cut)]


def prefix(counted: np.ndarray, others: np.ndarray, n: int, shared: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """The shingles of a set's prefix that other documents may hold.

    shared: sorted shingles that several documents hold, and ``documents`` how many.
    """
    at = np.searchsorted(shared, counted)
    known = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == counted) if len(shared) else np.zeros(len(counted), bool)
    many = np.ones(len(counted), np.int64)
    many[known] = documents[at[known]]
    order = np.lexsort((counted, many))[: prefix_size(n)]
    return np.concatenate([counted[order][many[order] > 1], others])


def sketch(own: np.ndarray) -> bytes:
    """Parities of a set's shingles by their low bits, about as many as shingles; they fold to half as many by xor."""
    size = 1 << max(6, (len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def least(own: np.ndarray) -> list[int]:
    """A number for each run of a set's least shingles by the orders; sets have it in common as often as they are similar, to the run's length."""
    if not len(own):
        return []
    first = [int(x) for x in (own[:, None] * ORDERS).min(axis=0)]
    runs = [first[a : a + n] + first[: max(0, a + n - len(first))] for a, n in RUNS]
    return [xxhash.xxh64_intdigest(np.array([a, *run], np.uint64).tobytes(), SEED) - (1 << 63) for (a, _), run in zip(RUNS, runs, strict=True)]


def brief(own: np.ndarray) -> list[int]:
    """Parities of a set's shingles by their low bits, in 64-bit numbers."""
    return np.packbits(np.bincount((own & np.uint64(BRIEF - 1)).astype(np.int64), minlength=BRIEF).astype(np.uint8) & 1).view(np.int64).tolist()


def may_be_similar(x: bytes, y: bytes, n: int, m: int) -> bool:
    """False only for sets (of sizes n and m) that are less similar: sketches differ in no more places than the sets."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum()) * (NUM + DEN) <= (n + m) * (DEN - NUM)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _sets(docs: DataFrame, wanted=None) -> DataFrame:
    """own: the set of each row of ``docs`` (key, text), beside its key; ``wanted``: of rows whose key's bit is set at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(wanted.value[batch.column(0).to_numpy() & (KEY_BITS - 1)]))
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingles(x.as_py()) for x in part.column(1)])], ["key", "own"])

    return docs.select("key", "text").mapInArrow(run, "key bigint, own array<bigint>")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, int]:
    """The pairs (a, b) of classes at the least similarity or above, and how many the sketches allow."""
    x, y = (classes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    drawn = pairs.join(x, "a").join(y, "b").select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([may_be_similar(*r) for r in rows], pa.bool_()))

    likely = materialise(drawn.mapInArrow(run, "a bigint, b bigint"), "near-likely")
    asked = likely.select(F.col("a").alias("class")).unionByName(likely.select(F.col("b").alias("class"))).distinct()
    shown = materialise(classes.select("class", "key").join(asked, "class"), "near-shown")
    bits = np.zeros(KEY_BITS, bool)  # of fixed size; keys that share a bit are told apart by the join
    bits[shown.select(F.col("key").bitwiseAND(F.lit(KEY_BITS - 1)).cast("int").alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True
    wanted = docs.sparkSession.sparkContext.broadcast(bits)
    sets = materialise(_sets(docs, wanted).join(shown, "key").select("class", "own"), "near-sets")
    both = likely.join(sets.select(F.col("class").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("own").alias("y")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    found = materialise(shared.where(F.col("i") * DEN >= (F.col("n") - F.col("i")) * NUM).select("a", "b").distinct(), "near-links")
    wanted.destroy()
    allowed = likely.count()
    for done in (likely, shown, sets):
        drop_table(done)
    return found, allowed


def _prints(docs: DataFrame) -> DataFrame:
    """A row for each of ``docs``; the set's parts are null but in the first row of a class that a task meets."""
    ddl = "key bigint, class bigint, n int, fp bigint, sketch binary, brief array<bigint>, least array<bigint>, chunk bigint, counted binary, others binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, chars, met = TaskContext.get().partitionId() << 24, 0, set()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part, rows = batch.slice(a, 500), []
                for x in part.column(1):
                    text = x.as_py()
                    own = shingles(text)
                    of = xxhash.xxh64_intdigest(own.tobytes(), SEED)
                    of -= (of >> 63) << 64
                    if of in met:
                        rows.append((of, len(own), 0, None, None, None, chunk, None, None))
                        continue
                    met.add(of)
                    counted, others = stored(own)
                    fp = majority(own)
                    rows.append((of, len(own), fp - ((fp >> 63) << 64), sketch(own), brief(own), least(own), chunk, counted.tobytes(), others.tobytes()))
                    chars += len(text or "")
                    if chars >= CHUNK_CHARS:
                        chars, chunk = 0, chunk + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [x.split()[0] for x in ddl.split(", ")])

    return docs.select("key", "text").mapInArrow(run, ddl)


def _met(prints: DataFrame) -> DataFrame:
    """class, n, s: the prefix shingles of each class that other documents may hold."""
    firsts = prints.where("counted IS NOT NULL").select("chunk", "class", "n", "counted", "others")
    total = firsts.agg(F.sum(F.length("counted")).alias("n")).first()["n"] or 0
    parts = max(16, -(-total // (8 * PART_HASHES)))
    edges = np.array([int(SHARE * 2**64) * k // parts for k in range(1, parts)], np.uint64)

    def cut(table: pa.Table) -> pa.Table:
        """Each chunk's counted shingles by ranges."""
        own = np.sort(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["counted"]]))
        at = [0, *np.searchsorted(own, edges).tolist(), len(own)]
        held = [(k, own[a:b].tobytes()) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
        return pa.table([pa.array([k for k, _ in held], pa.int32()), pa.array([table["chunk"][0].as_py()] * len(held), pa.int64()), pa.array([x for _, x in held], pa.binary())], ["part", "chunk", "held"])

    def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one chunk follow each other in a task."""
        run: list[pa.RecordBatch] = []
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            ends = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
            for a, b in zip(ends, ends[1:], strict=False):
                if b > a:
                    if run and run[-1].column(0)[0].as_py() != chunk[a]:
                        yield from cut(pa.Table.from_batches(run)).to_batches()
                        run = []
                    run.append(batch.slice(a, b - a))
        if run:
            yield from cut(pa.Table.from_batches(run)).to_batches()

    def count(table: pa.Table) -> pa.Table:
        """For each chunk, its shingles that come more than once in this range, and how often."""
        blobs = [np.frombuffer(x.as_py(), np.uint64) for x in table["held"]]
        found, many = np.unique(np.concatenate(blobs), return_counts=True)
        found, many = found[many > 1], many[many > 1].astype(np.int32)
        out = []
        for own in blobs:
            own = np.unique(own)
            at = np.searchsorted(found, own)
            at = at[(at < len(found)) & (found[np.minimum(at, len(found) - 1)] == own)] if len(found) else at[:0]
            out.append((found[at].tobytes(), many[at].tobytes()))
        return pa.table([table["chunk"], pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["chunk", "shared", "documents"])

    ranges = firsts.select("chunk", "counted").mapInArrow(by_chunk, "part int, chunk bigint, held binary")
    shared = ranges.groupBy("part").applyInArrow(count, "chunk bigint, shared binary, documents binary")

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_py(), np.uint64) for x in right["shared"]]
        own = np.concatenate(blobs) if blobs else np.zeros(0, np.uint64)
        many = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in right["documents"]]) if blobs else np.zeros(0, np.int32)
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1]))) if len(own) else order
        own, many = own[order][first], many[order][first]
        rows = [
            prefix(np.frombuffer(c.as_py(), np.uint64), np.frombuffer(o.as_py(), np.uint64), n, own, many)
            for c, o, n in zip(left["counted"], left["others"], left["n"].to_pylist(), strict=True)
        ]
        sizes = [len(x) for x in rows]
        s = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
        return pa.table([np.repeat(left["class"].to_numpy(), sizes), np.repeat(left["n"].to_numpy(), sizes), s], ["class", "n", "s"])

    return firsts.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(pick, "class bigint, n int, s bigint").distinct()


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, class) of each row of ``docs`` (key, text; equal keys have equal texts), and (class, component).

    A class that is alone has no component.  Null, empty and blank texts have no
    words and are one class; very long texts, ties and repeated rows need
    nothing of their own; an empty table gives two empty ones; other columns
    are ignored.
    """
    prints = materialise(_prints(docs), "near-prints")
    first = F.min(F.when(F.col("sketch").isNotNull(), F.struct("key", "n", "fp", "sketch", "brief", "least"))).alias("x")
    classes = materialise(prints.groupBy("class").agg(first).select("class", "x.*"), "near-classes")
    met = materialise(_met(prints), "near-met")
    sizes = lambda x, y: F.least(x, y) * DEN >= F.greatest(x, y) * NUM

    def verified(pairs: DataFrame) -> tuple[DataFrame, int]:
        drawn = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "near-pairs")
        found, allowed = _verified(drawn, docs, classes)
        drop_table(drawn)
        return found, allowed

    def stars(found: DataFrame, of: DataFrame | None = None) -> DataFrame:
        """(class, component) by the links found and, in place of those before them, the components so far."""
        edges = found if of is None else found.unionByName(of.select(F.col("class").alias("a"), F.col("component").alias("b")))
        star = components(edges).select(F.col("id").alias("class"), F.col("root").alias("component"))
        out = materialise(star.unionByName(star.select(F.col("component").alias("class"), "component").distinct()), "near-stars")
        for done in (found, of):
            if done is not None:
                drop_table(done)
        return out

    many = classes.count()

    def led(of: DataFrame, turn: int) -> DataFrame:
        """Each class and the leader of each of its runs of least shingles, if that is of another component."""
        held = classes.join(of, "class", "left").select("class", "n", F.coalesce("component", "class").alias("c"), F.explode("least").alias("s"))
        first = F.min(F.struct(F.xxhash64("class", F.lit(turn)).alias("h"), F.col("class").alias("b"), F.col("n").alias("m"), F.col("c").alias("d")))
        leaders = held.groupBy("s").agg(first.alias("x"), F.count(F.lit(1)).alias("many")).where("many > 1").select("s", "many", "x.b", "x.m", "x.d")
        met = join_by_count(held, materialise(leaders, "near-leaders"), "s", "many", many * len(RUNS))
        return met.where("c <> d").where(sizes(F.col("n"), F.col("m"))).select(F.col("class").alias("a"), "b")

    # fingerprints: their links, and classes of one fingerprint
    same = materialise(classes.where("n > 0").groupBy("fp").agg(F.min("class").alias("least"), F.count(F.lit(1)).alias("many")), "near-fps")
    a, b = (same.select(F.col("fp").alias(k), F.col("least").alias(f"class_{k}")) for k in "ab")
    across = links(same.select("fp")).join(a, "a").join(b, "b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    within = join_by_count(classes.where("n > 0").select("fp", F.col("class").alias("a")), same.where("many > 1").withColumnRenamed("least", "b"), "fp", "many", many).select("a", "b")
    of = stars(verified(across.unionByName(within))[0])
    for turn in range(ROUNDS):
        found, allowed = verified(led(of, turn))
        worth = found.count() * WORTH >= max(allowed, 1)
        of = stars(found, of)
        if not worth:
            break
    # all pairs that meet in a shingle and are still apart
    known = met.join(of, "class", "left").select("s", "class", "n", F.coalesce("component", "class").alias("c"))
    ends = known.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("s")
    known = materialise(known.join(ends, "s", "left_semi"), "near-known")
    words = range(BRIEF // 64)
    full = known.join(classes.select("class", *[F.col("brief")[k].alias(f"w{k}") for k in words]), "class")
    x, y = (full.select("s", *[F.col(c).alias(f"{c}_{k}") for c in ("class", "n", "c", *(f"w{i}" for i in words))]) for k in "ab")
    apart = sum((F.bit_count(F.col(f"w{k}_a").bitwiseXOR(F.col(f"w{k}_b"))) for k in words), F.lit(0))
    near = apart * (NUM + DEN) <= (F.col("n_a") + F.col("n_b")) * (DEN - NUM)
    pairs = x.join(y, "s").where("c_a < c_b").where(sizes(F.col("n_a"), F.col("n_b"))).where(near).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    of = stars(verified(pairs)[0], of)
    for done in (known, met):
        drop_table(done)
    return prints.select("key", "class"), of
