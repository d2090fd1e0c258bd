"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Inner product search becomes Euclidean search by one further component
(sqrt(1 - |x|^2) with the norms scaled to 1 at most; 0 for queries).  Each table
hashes ``hashes`` Gaussian projections into slots of one width; a query visits
its own bucket and perturbed ones in the order of their estimated success
(templates over the sorted distances to the slot borders).  Candidates of all
tables are reranked by the exact inner product.

Tables, hashes, width and probes are fitted on a bounded sample (``SAMPLE_ROWS``
vectors of each length) for the least work at the wanted recall; every row is
indexed.  Where neighbours stand out the fit takes narrow buckets and few
probes; vectors without structure need many.  Large buckets are salted over
several units of work, so nothing is capped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeforge.llm.common import bounded_sample
from placeforge.llm.vectors import best_rows, matrix, top, usable

SAMPLE_ROWS, SAMPLE_QUERIES, MOST_PROBES = 2000, 200, 64
#: (hashes, width) and numbers of tables that a fit chooses from; a visit costs as much as so many candidates.
CHOICES = ((12, 1.0), (8, 1.0), (8, 2.0), (8, 3.0), (6, 1.5), (6, 2.0), (4, 1.5), (4, 2.0), (3, 1.5), (3, 2.0))
TABLES = (2, 4, 8)
VISIT = 30.0


def templates(hashes: int, most: int) -> list[tuple[int, ...]]:
    """Perturbation sets as ranks among the 2 * hashes sorted border distances, likeliest first."""
    m = 2 * hashes
    expected = [
        j * (j + 1) / (4 * (hashes + 1) * (hashes + 2)) if j <= hashes
        else 1 - (m + 1 - j) / (hashes + 1) + (m + 1 - j) * (m + 2 - j) / (4 * (hashes + 1) * (hashes + 2))
        for j in range(1, m + 1)
    ]
    out: list[tuple[int, ...]] = [()]
    heap = [(expected[0], (0,))]
    while heap and len(out) < most:
        score, ranks = heapq.heappop(heap)
        if len({min(r, m - 1 - r) for r in ranks}) == len(ranks):  # not both borders of one slot
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < m:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (score + expected[last + 1], (*ranks, last + 1)))
    return out


@dataclass(frozen=True)
class Hashing:
    """One set of tables for vectors of ``dim`` components."""

    dim: int
    scale: float  # the largest norm
    tables: int
    hashes: int
    width: float
    probes: int
    seed: int = 11

    def _random(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lines, shifts, and what makes a bucket's key; the first tables are the same for any number of them."""
        rng = np.random.default_rng([self.seed, self.dim])
        most, n = TABLES[-1], self.tables * self.hashes
        lines, shifts = rng.standard_normal((most * self.hashes, self.dim + 1))[:n].T, rng.uniform(0, 1, most * self.hashes)[:n]
        return lines, shifts, rng.integers(1, 1 << 62, self.hashes) | 1, rng.integers(1, 1 << 62, most)[: self.tables]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table."""
        lines, shifts, mult, salt = self._random()
        x = x / self.scale
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
        slots = np.floor((x @ lines[:-1] + rest[:, None] * lines[-1]) / self.width + shifts).astype(np.int64)
        return (slots.reshape(len(x), self.tables, self.hashes) * mult).sum(axis=2) + salt

    def probe_keys(self, q: np.ndarray) -> np.ndarray:
        """Buckets of each query in each table, in visiting order: (rows, tables, probes)."""
        lines, shifts, mult, salt = self._random()
        q = q / np.sqrt((q * q).sum(axis=1))[:, None]
        at = ((q @ lines[:-1]) / self.width + shifts).reshape(len(q), self.tables, self.hashes)
        slots = np.floor(at)
        part = at - slots
        order = np.argsort(np.concatenate([part, 1 - part], axis=2), axis=2, kind="stable")
        base = (slots.astype(np.int64) * mult).sum(axis=2) + salt
        step = np.concatenate([-mult, mult])  # down below, up above
        moved = step[order]
        keys = [base + sum((moved[:, :, r] for r in ranks), np.int64(0)) for ranks in templates(self.hashes, self.probes)]
        return np.stack(keys, axis=2)


def fit(sample: np.ndarray, rows: int, scale: float, k: int, recall: float) -> Hashing:
    """The choice with the least work that finds ``recall`` of the sample's nearest.

    ``k`` of ``rows`` are as near as ``k * len(sample) / rows`` of the sample.
    Where no choice reaches the recall, the one that comes nearest is taken.
    """
    dim, n = sample.shape[1], len(sample)
    if n < 2:
        return Hashing(dim, scale, TABLES[-1], *CHOICES[-1], MOST_PROBES)
    queries = np.arange(n)[:: max(1, n // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    score = sample[queries] @ sample.T
    score[np.arange(len(queries)), queries] = -np.inf
    near = max(1, min(n - 1, -(-k * n // max(rows, 1))))
    truth = np.argsort(-score, axis=1, kind="stable")[:, :near]
    tried = []
    for hashes, width in CHOICES:
        widest = Hashing(dim, scale, TABLES[-1], hashes, width, MOST_PROBES)
        own, probes = widest.keys(sample), widest.probe_keys(sample[queries])
        size = probes.shape[2]
        first = np.full((TABLES[-1], len(queries), n), size, np.int16)  # the probe that finds a row
        for p in range(size - 1, -1, -1):
            for t in range(TABLES[-1]):
                first[t][probes[:, t, p][:, None] == own[:, t][None, :]] = p
        for tables in TABLES:
            found_at = np.take_along_axis(first[:tables].min(axis=0), truth, axis=1)
            for p in sorted({x for x in (1, 2, 4, 8, 12, 16, 24, 32, 48) if x < size} | {size}):
                got = (found_at < p).mean()
                if got >= recall or p == size:
                    work = (first[:tables] < p).sum() / len(queries) * rows / n + VISIT * tables * p
                    tried.append((-min(got, recall), work, Hashing(dim, scale, tables, hashes, width, p)))
                    break
    return min(tried, key=lambda x: x[:2])[2]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.97, unit_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest of ``vectors`` (vec_id, embedding) by inner product.

    Rows whose id or vector is null, whose vector is zero, or has a null or
    non-finite component take no part; nor does a query's own id.  Vectors are
    compared with those of equal length.  Rows repeated with one id count once,
    with their best score.  Ties go to the smaller id.  A query without
    candidates has no rows; other columns are ignored.
    """
    rows, asked = usable(vectors, zero=False), usable(queries, zero=False)
    rows, asked = rows.distinct(), asked.distinct()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    kinds = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("scale")).collect()  # a row per length
    sample = {r["dim"]: [x["v"] for x in bounded_sample(rows.where(F.col("dim") == r["dim"]), SAMPLE_ROWS, "vec_id", "v", size=r["n"]).select("v").collect()] for r in kinds}
    by_dim = {r["dim"]: fit(np.array(sample[r["dim"]]).reshape(-1, r["dim"]), r["n"], r["scale"], k, recall) for r in kinds}

    def spread(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                hashing = by_dim.get(int(dim))
                if hashing is None:
                    continue
                part = batch.filter(pa.array(dims == dim))
                x = matrix(part.column(1), int(dim))
                keys = hashing.probe_keys(x).reshape(len(x), -1) if query else hashing.keys(x)
                times = keys.shape[1]
                for a in range(0, len(x), max(1, 20_000 // times)):
                    some = np.repeat(np.arange(a, min(len(x), a + max(1, 20_000 // times))), times)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[some[0] : some[-1] + 1].ravel()), part.column(0).take(pa.array(some)), part.column(1).take(pa.array(some)), pa.array(np.full(len(some), dim, np.int32))],
                        ["bucket", "vec_id", "v", "dim"],
                    )

    ddl = "bucket bigint, vec_id bigint, v array<double>, dim int"
    own = rows.select("vec_id", "v", "dim").mapInArrow(lambda b: spread(b, False), ddl).withColumn("kind", F.lit(1))
    wanted = asked.select("vec_id", "v", "dim").mapInArrow(lambda b: spread(b, True), ddl).withColumn("kind", F.lit(0))
    # large buckets are dealt over several units; queries go to each of them
    large = own.groupBy("bucket", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > unit_rows)
    large = large.select("bucket", "dim", F.ceil(F.col("n") / unit_rows).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    own = own.join(large, ["bucket", "dim"], "left").withColumn("salt", F.pmod(F.xxhash64("vec_id"), salts).cast("int"))
    wanted = wanted.join(large, ["bucket", "dim"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    cols = [F.xxhash64("bucket", "dim", "salt").alias("unit"), "kind", "vec_id", "v", "dim"]
    dealt = own.select(*cols).unionByName(wanted.select(*cols)).repartition(F.col("unit")).sortWithinPartitions("unit", "dim", "kind")
    found = dealt.mapInArrow(lambda b: _scored(b, k), "query_id bigint, vec_id bigint, score double")
    return top(found, k, "score")


def _scored(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best pairs of each query with each run of rows; a query's worse ones are left out."""
    now: tuple | None = None
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    least: dict[int, float] = {}
    for batch in batches:
        unit, kind, dims = (batch.column(i).to_numpy() for i in (0, 1, 4))
        if not len(unit):
            continue
        new = np.flatnonzero((unit[1:] != unit[:-1]) | (kind[1:] != kind[:-1]) | (dims[1:] != dims[:-1])) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(unit)], strict=True):
            if now != (unit[a], dims[a]):
                now, ids, rows = (unit[a], dims[a]), [], []
            vec = batch.column(2).slice(a, b - a).to_numpy()
            x = matrix(batch.column(3).slice(a, b - a), int(dims[a]))
            if kind[a] == 0:
                ids.append(vec)
                rows.append(x)
            elif ids:
                if len(ids) > 1:
                    ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
                for c in range(0, len(ids[0]), 1024):
                    yield from _pairs(ids[0][c : c + 1024], rows[0][c : c + 1024], vec, x, k, least)


def _pairs(qid: np.ndarray, q: np.ndarray, vec: np.ndarray, x: np.ndarray, k: int, least: dict[int, float]) -> Iterator[pa.RecordBatch]:
    score = q @ x.T
    score[qid[:, None] == vec[None, :]] = -np.inf
    slack = 1e-9 * (1.0 + np.abs(np.where(np.isfinite(score), score, 0.0)).max(axis=1))
    floor = np.fromiter((least.get(i, -np.inf) for i in qid.tolist()), np.float64, len(qid))
    # an id counts once, with its best score
    order = np.argsort(vec, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], vec[order][1:] != vec[order][:-1])))
    once = score if len(starts) == len(vec) else np.maximum.reduceat(score[:, order], starts, axis=1)
    if once.shape[1] > k:
        floor = np.maximum(floor, np.partition(once, -k, axis=1)[:, -k])
    i, j = np.nonzero((score >= (floor - slack)[:, None]) & np.isfinite(score))
    if not len(i):
        return
    exact = (q[i] * x[j]).sum(axis=1)  # the same for a pair wherever it is met
    if len(starts) < len(vec):
        order = np.lexsort((-exact, vec[j], qid[i]))
        a, b = qid[i][order], vec[j][order]
        first = np.sort(order[np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))])
        i, j, exact = i[first], j[first], exact[first]
    keep = best_rows(qid[i], vec[j], exact, k)
    query, found, exact = qid[i][keep], vec[j][keep], exact[keep]
    ends = np.flatnonzero(np.concatenate((query[1:] != query[:-1], [True])))
    starts = np.concatenate(([0], ends[:-1] + 1))
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a + 1 == k and len(np.unique(found[a : b + 1])) == k:
            least[int(query[b])] = max(least.get(int(query[b]), -np.inf), float(exact[b]))
    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found), pa.array(exact)], ["query_id", "vec_id", "score"])
