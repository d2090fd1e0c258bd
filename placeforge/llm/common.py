"""Helpers shared by the corpus operators: shared scratch folder, tables, hashing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeforge.sources.tables import shared_dir as scratch_dir

#: Byte values that separate words: space and \x09-\x0D.  ``bytes.split()``
#: splits at exactly these, ``bytes.lower()`` folds exactly A-Z.
WORD_SEPARATORS = b" \t\n\x0b\x0c\r"


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


#: Tables that this process has made and not removed.
_MADE: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    Lineage ends there: an executor that is lost afterwards costs no
    recomputation.  Results are lazy and read these tables, so they stay until
    ``remove_tables``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()  # Spark removes the shuffle files of what the driver no longer holds
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Removes a table made by ``materialise`` that nothing reads any more."""
    for at in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        _MADE[:] = [x for x in _MADE if x.rsplit("/", 1)[-1] != at.rsplit("/", 1)[-1]]


def remove_tables(spark: SparkSession) -> int:
    """Removes all tables made by ``materialise``, once the results are written; how many there were."""
    count = len(_MADE)
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return count


def unit_hash(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def bounded_sample(rows: DataFrame, most: int, *by: Column | str, size: int | None = None) -> DataFrame:
    """``most`` rows at most, those of the least hash of ``by``; equal rows count one by one.

    Most other rows are left out before the sort, so that it moves few.
    """
    size = rows.count() if size is None else size
    if size <= most:
        return rows
    share = F.lit(min(1.0, 1.5 * most / size + 20 / size))
    near = rows.where(unit_hash(*by) < share)
    if near.limit(most).count() < most:  # few values, each many times: rows one by one
        near = rows.where(unit_hash(*by, F.monotonically_increasing_id()) < share)
    return near.orderBy(unit_hash(*by)).limit(most)


#: At most so many keys are frequent.
FREQUENT = 10_000


def join_by_count(rows: DataFrame, of_key: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """The inner join of ``rows`` with ``of_key``, a row per key that holds the ``count`` of its rows.

    Keys of more than a ``FREQUENT``-th of ``total``, the number of rows, are
    fewer than ``FREQUENT``: they are broadcast, so that their rows stay where
    they are.  The others' rows are few per key, and shuffled.
    """
    floor = max(100, -(-total // FREQUENT))
    many = F.broadcast(of_key.where(F.col(count) > floor))
    few = rows.join(F.broadcast(of_key.where(F.col(count) > floor).select(key)), key, "left_anti")
    return rows.join(many, key).unionByName(few.join(of_key.where(F.col(count) <= floor), key))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
