"""SimHash near-duplicate components by a segment-popcount embedding.

1. Each text gets a 64-bit fingerprint of its word shingles.
2. Equal fingerprints form one class, so copies cost nothing further on.
3. A fingerprint is embedded as its bit counts per segment of two bits.  The
   Manhattan distance of two embeddings never exceeds the Hamming distance of
   the fingerprints, so a range join of radius 4 on the embeddings loses no
   link.  The join uses grids: the segments are cut into ``groups`` groups, and
   with at most 4 units of distance to give away, at least ``groups - 4`` of
   them agree exactly.  Every choice of ``groups - 4`` groups is one grid, its
   cells the embeddings of those groups.  Within a cell pairs are tested first
   by Manhattan distance, then exactly.
4. Cells above ``cell_rows`` are cut into blocks, one unit of work per pair of
   blocks, so that no task holds an unbounded cell.  Workers give back a
   spanning forest of the links that they found, never all pairs.
5. Components come from alternating star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeforge.llm.common import join_by_count, materialise, words_of

SEED = 42
MAX_DISTANCE = 4
SEGMENT_BITS = 2
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned SimHash: a bit is set if it is set in over half of the shingles' XXH64."""
    words = words_of(text)
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        spans = zip(starts[lo:hi].tolist(), ends[lo + k - 1 : hi + k - 1].tolist(), strict=True)
        hashes = np.fromiter(
            map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in spans], repeat(SEED)), np.uint64, hi - lo
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[lo : lo + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (long, the fingerprint's bits) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def group_masks(groups: int) -> list[int]:
    """Bit masks of the groups of whole segments."""
    segments = 64 // SEGMENT_BITS
    cuts = [round(i * segments / groups) * SEGMENT_BITS for i in range(groups + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def groups_for(n: int) -> int:
    """More groups make finer cells and more grids; the links found are the same for each choice."""
    return 6 if n < 50_000_000 else 7 if n < 5_000_000_000 else 8


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Low and high bit of each two-bit segment.
_LOW = 0x5555555555555555


def popcount_vector(fp: Column) -> Column:
    """The embedding packed in a long: each two-bit segment holds its bit count (0, 1 or 2)."""
    low = F.lit(_LOW)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    # a segment's sum: low bit a xor b, high bit a and b
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _vector(fp: np.ndarray) -> np.ndarray:
    low = np.uint64(_LOW)
    a, b = fp & low, (fp >> np.uint64(1)) & low
    return (a ^ b) | ((a & b) << np.uint64(1))


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings: the sum of |x - y| over the segments.

    For values 0, 1, 2 coded in two bits, |x - y| is 2 exactly for {0, 2},
    1 for neighbours: the count of (x ^ y) after 1 and 2 are told apart.
    """
    low = np.uint64(_LOW)
    x1, x2 = x & low, (x >> np.uint64(1)) & low
    y1, y2 = y & low, (y >> np.uint64(1)) & low
    # as unary codes: at least one, at least two
    return np.bitwise_count((x1 | x2) ^ (y1 | y2)) + np.bitwise_count(x2 ^ y2)


def links(classes: DataFrame, max_distance: int = MAX_DISTANCE, cell_rows: int = 4096, groups: int | None = None) -> DataFrame:
    """a, b: links between distinct fingerprints ``fp`` that connect all pairs within ``max_distance``."""
    groups = groups or groups_for(classes.count())
    equal = groups - max_distance
    if equal < 1:
        raise ValueError("groups must exceed max_distance")
    masks = group_masks(groups)
    grids = [sum(masks[i] for i in chosen) for chosen in combinations(range(groups), equal)]
    vec = popcount_vector(F.col("fp"))
    cells = classes.select(
        "fp",
        F.posexplode(F.array(*[vec.bitwiseAND(F.lit(_signed(m))) for m in grids])).alias("grid", "cell"),
    )
    # blocks: one for almost every cell
    large = (
        cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows)
        .select("grid", "cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("blocks"))
    )
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    units = (
        cells.join(large, ["grid", "cell"], "left")
        .select("grid", "cell", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("grid", "cell", "fp", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    )
    # one key for a unit of work; what meets by chance is told apart by the cells themselves
    keyed = units.select(F.xxhash64("grid", "cell", "p", "q").alias("unit"), "grid", "fp", "own", (F.col("p") == F.col("q")).alias("inner"))
    dealt = keyed.repartition(F.col("unit")).sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [
                batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False),
                batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False),
                batch.column(4).to_numpy(zero_copy_only=False),
            ]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            # the last unit may go on in the next batch
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left")) if len(cols[0]) else 0
            yield from _forest(*[c[:cut] for c in cols], grids=grids, max_distance=max_distance)
            rest = [c[cut:] for c in cols]
        if rest is not None:
            yield from _forest(*rest, grids=grids, max_distance=max_distance)

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _forest(unit: np.ndarray, grid: np.ndarray, fp: np.ndarray, own: np.ndarray, inner: np.ndarray, grids: list[int], max_distance: int) -> Iterator[pa.RecordBatch]:
    """Links within the units of sorted arrays, thinned to a spanning forest."""
    found_a, found_b = [], []
    vec = _vector(fp)
    mask = np.array(grids, np.uint64)
    at = np.arange(len(unit) - 1)
    lag = 1
    while len(at):
        at = at[at + lag < len(unit)]
        at = at[unit[at] == unit[at + lag]]
        i, j = at, at + lag
        # blocks of two: only pairs across them
        ok = inner[i] | (own[i] != own[j])
        i, j = i[ok], j[ok]
        near = manhattan(vec[i], vec[j]) <= max_distance
        i, j = i[near], j[near]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= max_distance
        i, j = i[near], j[near]
        if len(i):
            # a pair belongs to the first grid in which it shares a cell
            shared = ((vec[i] ^ vec[j])[:, None] & mask[None, :]) == 0
            first = shared.argmax(axis=1) == grid[i]
            found_a.append(fp[i][first])
            found_b.append(fp[j][first])
        lag += 1
    if not found_a:
        return
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            keep[k] = True
    if keep.any():
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64))], ["a", "b"]
        )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """id, root: the least vertex of each vertex's component, for the vertices of ``edges`` (a, b).

    Alternating large-star and small-star rounds; each ends in a checkpoint.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = now.checkpoint()
    before = None
    for _ in range(max_rounds):
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if not sign["n"] or before == sign:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = sign
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        now = small.select("e.a", "e.b").where("a <> b").distinct().checkpoint()
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = MAX_DISTANCE, cell_rows: int = 4096, groups: int | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id, n_class for each row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero and link like any other; rows
    repeated with one doc_id stay apart; a null doc_id takes part but is never
    a component's id unless no other is there; an empty table gives no rows;
    other columns are ignored.  n_class counts the rows of equal fingerprint.
    """
    prints = materialise(fingerprints(docs, shingle), "simhash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_class"))
    found = components(links(classes.select("fp"), max_distance, cell_rows, groups))
    # a root is not among the ids of its star
    member = found.select(F.col("id").alias("fp"), "root").unionByName(found.select(F.col("root").alias("fp"), "root").distinct())
    linked = member.join(classes.select("fp", "rep"), "fp")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = linked.join(least, "root").select("fp", "component_id")
    known = classes.join(of_class, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), "n_class")
    return join_by_count(prints, materialise(known, "simhash-classes"), "fp", "n_class", prints.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_class"
    )
