"""Exact top-k by integer inner product: best-first search in M-trees.

Vectors are turned into integers, floor(256 * x).  One further component makes
all points of one vector length equally long, so that the largest inner product
is the smallest Euclidean distance.  Points go to the nearest of at most
``MOST_REGIONS`` routing points, fitted on a bounded sample (``SAMPLE_ROWS`` of
each vector length); a region is dealt by hash to trees of about ``tree_rows``,
whose root has the region's routing point.  A tree is a table of pages.  A page
has a routing point, a covering radius and its distance to the parent's routing
point; a leaf has its entries' distances to the routing point.

A query first searches one tree of its nearest region.  The k-th score found
there bounds its reach: it goes on only to the regions that this bound admits.
Within a tree it takes the page of smallest possible distance first, and leaves
out pages and entries by the stored distances and the triangle inequality,
before computing theirs.

Scores, and the squared norms of the integer vectors, must fit a long; a search
over vectors whose squared norms do not fails.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeforge.llm.common import bounded_sample, materialise
from placeforge.llm.vectors import matrix, top, usable

FANOUT = 16
MOST_REGIONS, SAMPLE_ROWS = 256, 4096


@dataclass
class Page:
    node: int
    parent: int
    parent_dist: float
    radius: float
    length2: int  # squared length of all points
    pivot: np.ndarray  # integers
    ids: np.ndarray  # of a leaf's entries
    rows: np.ndarray  # their integer vectors
    dists: np.ndarray  # their distances to the pivot


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * x).astype(np.int64)


def _points(rows: np.ndarray, length2: int) -> np.ndarray:
    """The rows with the component that makes all of them ``length2`` in square."""
    return np.hstack([rows, np.sqrt((length2 - (rows * rows).sum(axis=1)).astype(np.float64))[:, None]])


def routing_points(sample: np.ndarray, length2: int, many: int) -> np.ndarray:
    """``many`` rows of the sample at most, each near the middle of the rows nearest to it."""
    sample = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])]
    points = _points(sample, length2)
    chosen = np.arange(min(many, len(sample)))
    for _ in range(6):
        nearest = (points @ points[chosen].T).argmax(axis=1)
        for c in range(len(chosen)):
            own = np.flatnonzero(nearest == c)
            if len(own):
                chosen[c] = own[((points[own] - points[own].mean(axis=0)) ** 2).sum(axis=1).argmin()]
    return sample[np.unique(chosen)]


def build(ids: np.ndarray, rows: np.ndarray, page_rows: int, length2: int | None = None, routing: np.ndarray | None = None) -> list[Page]:
    """Pages of a tree over integer vectors, the root first; its routing point is ``routing``, else the first row."""
    length2 = int((rows * rows).sum(axis=1).max()) if length2 is None else length2
    points = _points(rows, length2)
    middle, root = (points[0], rows[0]) if routing is None else (_points(routing[None, :], length2)[0], routing)
    pages: list[Page] = []
    todo = [(np.arange(len(ids)), middle, root, -1, 0.0)]
    while todo:
        own, at, pivot, parent, parent_dist = todo.pop()
        dist = np.sqrt(((points[own] - at) ** 2).sum(axis=1))
        leaf = len(own) <= page_rows
        node = len(pages)
        held = own if leaf else own[:0]
        pages.append(Page(node, parent, parent_dist, float(dist.max()), length2, pivot, ids[held], rows[held], dist if leaf else dist[:0]))
        if leaf:
            continue
        m = min(FANOUT, -(-len(own) // page_rows))
        pivots = own[np.linspace(0, len(own) - 1, m).astype(np.int64)]
        apart = np.stack([((points[own] - points[p]) ** 2).sum(axis=1) for p in pivots])
        nearest = apart.argmin(axis=0)
        parts = [(own[nearest == k], p) for k, p in enumerate(pivots)]
        if max(len(x) for x, _ in parts) > 0.9 * len(own):  # copies: any even cut does
            parts = [(x, x[0]) for x in np.array_split(own[np.argsort(dist, kind="stable")], m)]
        for x, p in parts:
            if len(x):
                todo.append((x, points[p], rows[p], node, float(np.sqrt(((points[p] - at) ** 2).sum()))))
    return pages


def walk(pages: list[Page], qids: np.ndarray, queries: np.ndarray, k: int, least: dict[int, int] | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Each query's k best (scores, ids) in the tree, and how many distances were computed.

    least: a score that k candidates elsewhere are known to reach.
    """
    children: dict[int, list[int]] = {}
    for p in pages:
        children.setdefault(p.parent, []).append(p.node)
    by_node = {p.node: p for p in pages}
    length2 = pages[0].length2
    # products of small integers are exact in floating point
    high = max([np.abs(queries).max(initial=0), *(np.abs(p.rows).max(initial=0) for p in pages), *(np.abs(p.pivot).max(initial=0) for p in pages)])
    kind = np.float64 if int(high) ** 2 * max(1, queries.shape[1]) < 2**52 else np.int64
    pivots = {n: np.stack([by_node[c].pivot for c in cs]).astype(kind) for n, cs in children.items()}
    rows = {p.node: p.rows.astype(kind) for p in pages if len(p.ids)}
    once = {p.node: len(np.unique(p.ids)) == len(p.ids) for p in pages if len(p.ids)}
    bounds = {n: (np.array([by_node[c].parent_dist for c in cs]), np.array([by_node[c].radius for c in cs])) for n, cs in children.items()}
    out, computed = [], 0
    for qid, query in zip(qids.tolist(), queries, strict=True):
        q, q2 = query.astype(kind), int((query.astype(object) ** 2).sum())
        slack = 1e-6 * (1.0 + np.sqrt(float(q2)) + np.sqrt(float(length2)))
        scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor = (least or {}).get(qid)
        reach = np.inf if floor is None else np.sqrt(max(0.0, float(q2 + length2 - 2 * floor)))
        heap: list[tuple[float, int, float]] = [(0.0, -1, 0.0)]
        while heap:
            bound, node, dist = heapq.heappop(heap)
            if bound > reach + slack:
                break
            if node in children:
                parent_dist, radius = bounds[node]
                seen = np.arange(len(radius)) if node < 0 else np.flatnonzero(np.abs(dist - parent_dist) - radius <= reach + slack)
                if not len(seen):
                    continue
                computed += len(seen)
                d = np.sqrt(np.maximum(0.0, (q2 + length2 - 2 * (pivots[node][seen] @ q)).astype(np.float64)))
                for c, x in zip(seen.tolist(), d.tolist(), strict=True):
                    if (low := max(0.0, x - radius[c])) <= reach + slack:
                        heapq.heappush(heap, (low, children[node][c], x))
                continue
            page = by_node[node]
            seen = np.flatnonzero((np.abs(dist - page.dists) <= reach + slack) & (page.ids != qid))
            if not len(seen):
                continue
            computed += len(seen)
            scores = np.concatenate([scores, (rows[node][seen] @ q).astype(np.int64)])
            ids = np.concatenate([ids, page.ids[seen]])
            # an id that comes again counts once, with its best score
            best = np.lexsort((ids, -scores))
            if once[node] and len(best) > 4 * k:  # an id comes twice at most
                cut = np.partition(scores, -2 * k)[-2 * k]
                best = best[: np.searchsorted(-scores[best], -cut, "right")]
            _, first = np.unique(ids[best], return_index=True)
            best = best[np.sort(first)][:k]
            scores, ids = scores[best], ids[best]
            if len(ids) == k:
                reach = min(reach, np.sqrt(max(0.0, float(q2 + length2 - 2 * int(scores[-1])))))
        out.append((scores, ids))
    return out, computed


_PAGE = "dim int, region int, salt int, node int, parent int, parent_dist double, radius double, length2 bigint, pivot array<bigint>, ids array<bigint>, rows array<bigint>, dists array<double>"
_TREE = ["dim", "region", "salt"]


@dataclass(frozen=True)
class Space:
    """The regions of the vectors of one length."""

    length2: int
    routing: np.ndarray | None  # integers; none: one region

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        if self.routing is None:
            return np.zeros(len(rows), np.int32)
        return (_points(rows, self.length2) @ _points(self.routing, self.length2).T).argmax(axis=1).astype(np.int32)


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of batches (dim, ...) of one dim and 4,096 rows at most."""
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            for a in range(0, part.num_rows, 4096):
                yield int(dim), part.slice(a, 4096)


def index(vectors: DataFrame, tree_rows: int = 8192, page_rows: int = 256) -> tuple[DataFrame, dict[int, Space]]:
    """The table of all trees' pages, and the regions by vector length."""
    rows = usable(vectors).select("dim", "vec_id", "v").distinct()
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + F.floor(256.0 * x) * F.floor(256.0 * x))
    spaces: dict[int, Space] = {}
    for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("length2")).collect():  # a row per length
        many, routing = min(MOST_REGIONS, -(-r["n"] // tree_rows)), None
        if many > 1:
            sample = bounded_sample(rows.where(F.col("dim") == r["dim"]), SAMPLE_ROWS, "vec_id", "v", size=r["n"]).select("v").collect()
            routing = routing_points(whole(np.array([x["v"] for x in sample])), r["length2"], many)
        spaces[r["dim"]] = Space(r["length2"], routing)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in _by_dim(batches):
            region = spaces[dim].nearest(whole(matrix(part.column(2), dim)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(region)], ["dim", "vec_id", "v", "region"])

    placed = materialise(rows.mapInArrow(place, "dim int, vec_id bigint, v array<double>, region int"), "mtree-rows")
    # MOST_REGIONS rows of each length at most
    salts = placed.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / tree_rows).cast("int").alias("salts"))
    dealt = placed.join(F.broadcast(salts), ["dim", "region"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), "salts").cast("int"))

    def grow(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tree = {c: table[c][0].as_py() for c in _TREE}
        space, ids = spaces[tree["dim"]], table["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        routing = None if space.routing is None else space.routing[tree["region"]]
        pages = build(ids[order], whole(matrix(table["v"].combine_chunks(), tree["dim"]))[order], page_rows, space.length2, routing)
        found = [tree | {k: (x.ravel().tolist() if isinstance(x, np.ndarray) else x) for k, x in vars(p).items()} for p in pages]
        return pa.Table.from_pylist(found, schema=_schema())

    return materialise(dealt.select(*_TREE, "vec_id", "v").groupBy(*_TREE).applyInArrow(grow, _PAGE), "mtree"), spaces


def _schema() -> pa.Schema:
    ints, longs = pa.int32(), pa.list_(pa.int64())
    return pa.schema([("dim", ints), ("region", ints), ("salt", ints), ("node", ints), ("parent", ints), ("parent_dist", pa.float64()), ("radius", pa.float64()), ("length2", pa.int64()), ("pivot", longs), ("ids", longs), ("rows", longs), ("dists", pa.list_(pa.float64()))])


def visits(asked: DataFrame, spaces: dict[int, Space], regions: dict[int, dict[int, tuple[float, int]]], first: bool) -> DataFrame:
    """dim, region, salt, qid, v, least: the trees that queries (dim, qid, v, least) go to.

    regions: covering radius and number of trees by length and region.  ``first``:
    one tree of the nearest region; else all others that the score ``least`` admits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in _by_dim(batches):
            if dim not in regions:
                continue
            space, own = spaces[dim], regions[dim]
            q, qid = whole(matrix(part.column(2), dim)), part.column(1).to_numpy()
            known = np.array(sorted(own))
            radius, trees = np.array([own[r][0] for r in known.tolist()]), np.array([own[r][1] for r in known.tolist()])
            square = (q.astype(np.float64) ** 2).sum(axis=1)
            if space.routing is None:
                dist = np.zeros((len(q), 1))
            else:
                dist = np.sqrt(np.maximum(0.0, square[:, None] + space.length2 - 2.0 * (q.astype(np.float64) @ space.routing[known].T.astype(np.float64))))
            nearest = dist.argmin(axis=1)
            start = qid % trees[nearest]
            if first:
                at, region, salt = np.arange(len(q)), nearest, start
            else:
                least = part.column(3).to_numpy(zero_copy_only=False).astype(np.float64)  # null: nan
                reach = np.sqrt(np.maximum(0.0, square + space.length2 - 2.0 * least))
                slack = 1e-6 * (1.0 + np.sqrt(square) + np.sqrt(float(space.length2)))
                open_ = np.isnan(reach)[:, None] | (np.maximum(0.0, dist - radius) <= (reach + slack)[:, None])
                at, region = np.nonzero(open_) if space.routing is not None else (np.arange(len(q)), np.zeros(len(q), np.int64))
                times = trees[region]
                salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at, region = np.repeat(at, times), np.repeat(region, times)
                rest = (region != nearest[at]) | (salt != start[at])
                at, region, salt = at[rest], region[rest], salt[rest]
            for a in range(0, len(at), 8192):
                some = part.take(pa.array(at[a : a + 8192]))
                cols = [some.column(0), pa.array(known[region[a : a + 8192]].astype(np.int32)), pa.array(salt[a : a + 8192].astype(np.int32)), *some.columns[1:]]
                yield pa.RecordBatch.from_arrays(cols, [*_TREE, "qid", "v", "least"])

    return asked.select("dim", "qid", "v", "least").mapInArrow(run, "dim int, region int, salt int, qid bigint, v array<double>, least bigint")


def _searched(pages: DataFrame, going: DataFrame, k: int, block_rows: int) -> DataFrame:
    """query_id, vec_id, score: each query's best of each tree it goes to; a tree's pages are read once per block of its queries."""
    blocks = going.groupBy(*_TREE).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    left = pages.join(blocks, _TREE).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = going.join(blocks, _TREE).withColumn("block", F.pmod(F.xxhash64("qid", "v"), "blocks").cast("int")).drop("blocks")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        dim = a["dim"][0].as_py()
        cols = {c: a[c].to_pylist() for c in ("node", "parent", "parent_dist", "radius", "length2")}
        lists = {c: [np.array(x.values.to_numpy(zero_copy_only=False)) for x in a[c]] for c in ("pivot", "ids", "rows", "dists")}
        tree = [
            Page(**{c: x[i] for c, x in cols.items()}, pivot=lists["pivot"][i], ids=lists["ids"][i], rows=lists["rows"][i].reshape(-1, dim), dists=lists["dists"][i])
            for i in range(a.num_rows)
        ]
        tree.sort(key=lambda p: p.node)
        qids = b["qid"].to_numpy()
        least = {q: x for q, x in zip(qids.tolist(), b["least"].to_pylist(), strict=True) if x is not None}
        best, _ = walk(tree, qids, whole(matrix(b["v"].combine_chunks(), dim)), k, least)
        return pa.table(
            [np.repeat(qids, [len(i) for _, i in best]), np.concatenate([i for _, i in best]), np.concatenate([s for s, _ in best])], names
        )

    by = [*_TREE, "block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")


def regions_of(pages: DataFrame) -> dict[int, dict[int, tuple[float, int]]]:
    """Covering radius and number of trees by length and region, MOST_REGIONS of each length at most."""
    out: dict[int, dict[int, tuple[float, int]]] = {}
    for r in pages.where("parent = -1").groupBy("dim", "region").agg(F.max("radius").alias("radius"), F.max("salt").alias("salt")).collect():
        out.setdefault(r["dim"], {})[r["region"]] = (r["radius"], r["salt"] + 1)
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, tree_rows: int = 8192, page_rows: int = 256, block_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score (long): each query's ``k`` largest integer inner products.

    Rows whose id or vector is null, or whose vector has a null or non-finite
    component take no part; nor does a query's own id.  Vectors are compared
    with those of equal length.  Rows repeated with one id count once, with
    their best score.  Ties go to the smaller id; other columns are ignored.
    An empty table, or no queries, gives no rows.
    """
    pages, spaces = index(vectors, tree_rows, page_rows)
    regions = regions_of(pages)
    asked = usable(queries).select("dim", F.col("vec_id").alias("qid"), "v").distinct()
    near = materialise(visits(asked.withColumn("least", F.lit(None).cast("long")), spaces, regions, first=True), "mtree-first")
    found = materialise(_searched(pages, near, k, block_rows), "mtree-found")
    least = top(found, k, "score").where(F.col("rank") == k).select(F.col("query_id").alias("qid"), F.col("score").alias("least"))
    rest = materialise(visits(asked.join(least, "qid", "left"), spaces, regions, first=False), "mtree-rest")
    return top(found.unionByName(_searched(pages, rest, k, block_rows)), k, "score")
