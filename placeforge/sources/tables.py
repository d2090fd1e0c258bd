"""Readers and writers: Parquet, JDBC, CSV, NDJSON, parameterised SQL, staged publication."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeforge.config import Settings, get_settings
from placeforge.schemas import GOLDEN


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_options(table: str, settings: Settings | None = None, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 64) -> dict[str, str]:
    """Options of a JDBC read; with ``column`` and ``bounds`` the table is read in parallel ranges."""
    s = settings or get_settings()
    options = {"url": s.jdbc_url, "dbtable": table, "user": s.jdbc_user, "password": s.jdbc_password, "fetchsize": "10000"}
    if column and bounds:
        options |= {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return options


def read_jdbc(spark: SparkSession, table: str, **more: Any) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(table, **more)).load()


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases; an empty cell is an empty text, not null."""
    rows = spark.read.csv(path, header=True, schema=GOLDEN, emptyValue="", nullValue="\0", quote='"', escape='"', enforceSchema=False)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])


def fetch_all(spark: SparkSession, sql: str, **params: Any) -> list[dict[str, Any]]:
    """All rows of a parameterised query (``:name``), for small results."""
    return [r.asDict(recursive=True) for r in spark.sql(sql, args=params).toLocalIterator()]


def fetch_one(spark: SparkSession, sql: str, **params: Any) -> dict[str, Any] | None:
    row = spark.sql(sql, args=params).first()
    return None if row is None else row.asDict(recursive=True)


def scalar(spark: SparkSession, sql: str, **params: Any) -> Any:
    row = spark.sql(sql, args=params).first()
    return None if row is None else row[0]


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop file system of a path, and how to make paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


_CURRENT = "_current"


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Version folders named by the table's pointer: the current one, then the one before."""
    fs, hadoop = _files(spark, path)
    pointer = hadoop(f"{path}/{_CURRENT}")
    if not fs.exists(pointer):
        return []
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(pointer)))
    lines = [reader.readLine(), reader.readLine()]
    reader.close()
    return [x for x in lines if x]


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Replaces a table, and gives its new version.

    A version is written whole into a folder of its own; then the pointer file
    is replaced by one rename, so ``read_published`` finds the old version or
    the new one, never neither.  The version before stays for readers that have
    begun; older ones go.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    fs, hadoop = _files(spark, path)
    before, version = _versions(spark, path), f"v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{version}")
    staged = hadoop(f"{path}/{_CURRENT}-{version}")
    out = fs.create(staged, True)
    out.write(bytearray("\n".join([version, *before[:1]]).encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    overwrite = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    overwrite[0] = jvm.Options.Rename.OVERWRITE
    context = jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(staged), fs.makeQualified(hadoop(f"{path}/{_CURRENT}")), overwrite)
    for old in before[1:]:
        fs.delete(hadoop(f"{path}/{old}"), True)
    return version


def read_published(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of a published table, or a plain Parquet table; None where there is none."""
    path = path.rstrip("/")
    fs, hadoop = _files(spark, path)
    if not fs.exists(hadoop(path)):
        return None
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/{versions[0]}" if versions else path)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; only a local session gets a folder made where it is unset."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        base = context.getConf().get("spark.checkpoint.dir")
        if not base and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="placeforge-"))
        held = context._jsc.sc().getCheckpointDir()
    return context.getConf().get("spark.checkpoint.dir", held.get()).rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Computes a frame that several others use, once, into the cluster's shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def ping(spark: SparkSession) -> dict[str, str]:
    """Whether the session answers, and the version of its engine."""
    return {"answers": str(scalar(spark, "SELECT 1") == 1).lower(), "version": scalar(spark, "SELECT version()")}


def drop(spark: SparkSession, path: str) -> None:
    """Removes a table if it is there."""
    fs, hadoop = _files(spark, path)
    fs.delete(hadoop(path), True)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON document, nulls left in."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def fit_widths(df: DataFrame, widths: dict[str, int], truncate: bool = False) -> DataFrame:
    """Text columns within their widths: too long a value fails the query, or is cut if ``truncate`` is set."""
    out = {}
    for name, width in widths.items():
        if name in df.columns and isinstance(df.schema[name].dataType, T.StringType):
            c = F.col(name)
            bad = F.raise_error(F.concat(F.lit(f"{name} is longer than {width}: "), c)).cast("string")
            out[name] = F.substring(c, 1, width) if truncate else F.when(F.length(c) > width, bad).otherwise(c)
    return df.withColumns(out) if out else df
