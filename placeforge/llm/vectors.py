"""Vector rows shared by the two searches: which take part, batches as matrices, top lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(c: Column) -> Column:
    """Not null, and no component null or non-finite."""
    return F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(c) > 0)


def usable(vectors: DataFrame, zero: bool = True) -> DataFrame:
    """vec_id, v (array<double>), dim of the rows that take part; ``zero``: zero vectors as well."""
    v = F.col("embedding").cast(T.ArrayType(T.DoubleType()))
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & finite(F.col("v")))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix; all have ``dim`` components."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def best_rows(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best rows, best first, ties to the smaller vec."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[np.arange(len(q)) - start < k]


def top(found: DataFrame, k: int, score: str) -> DataFrame:
    """query_id, rank, vec_id, score of rows (query_id, vec_id, score): a pair found twice counts once."""
    from pyspark.sql import Window

    once = found.groupBy("query_id", "vec_id").agg(F.max(score).alias(score))
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col("vec_id"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)
