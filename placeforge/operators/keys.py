"""Norm keys of derived tables: filling, verification, health."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeforge.functions.text import NORM_VERSION, normalize


def missing(key: str) -> Column:
    return F.col(key).isNull() | (F.col(key) == "")


def backfill(table: DataFrame, source: str, key: str, only_missing: bool = True, version: str = NORM_VERSION) -> DataFrame:
    """Fills ``key`` from ``source``: a projection.  With ``only_missing`` rows of an older version keep their key and version."""
    due = missing(key) if only_missing else F.lit(True)
    return table.withColumns({
        key: F.when(due, normalize(source)).otherwise(F.col(key)),
        "norm_version": F.when(due, F.lit(version)).otherwise(F.col("norm_version")),
    })


def verify(tables: Mapping[str, tuple[DataFrame, str]], version: str = NORM_VERSION) -> DataFrame:
    """table, missing, stale, ok: a row per table.  A text whose normal form is empty counts as missing."""
    rows = None
    for name, (table, key) in sorted(tables.items()):
        row = table.agg(F.count_if(missing(key)).alias("missing"), F.count_if(F.col("norm_version") != version).alias("stale"))
        row = row.select(F.lit(name).alias("table"), "missing", "stale", ((F.col("missing") == 0) & (F.col("stale") == 0)).alias("ok"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def health(tables: Mapping[str, DataFrame | None], keys: Mapping[str, str]) -> DataFrame:
    """table, n, key_missing: counts per table; null where a table is not there, or has no key."""
    rows = None
    for name in sorted(tables):
        table, key = tables[name], keys.get(name)
        spark = next(t for t in tables.values() if t is not None).sparkSession
        if table is None:
            row = spark.range(1).select(F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("key_missing"))
        else:
            row = table.agg(F.count(F.lit(1)).alias("n"), (F.count_if(missing(key)) if key else F.lit(None).cast("long")).alias("key_missing"))
        row = row.select(F.lit(name).alias("table"), "n", "key_missing")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def problems(report: list[dict]) -> list[str]:
    """What a health report complains of.  A table that is not there is a problem as well."""
    found = [f"{r['table']} is not there" for r in report if r["n"] is None]
    return found + [f"{r['table']} has {r['key_missing']} rows without a key" for r in report if r["key_missing"]]
