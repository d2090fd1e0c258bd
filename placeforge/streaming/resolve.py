"""Streams of location texts: normalised keys, and lookup in a static gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placeforge.functions.text import NORM_VERSION, normalize, strip_qualifiers


def with_keys(stream: DataFrame, text: str) -> DataFrame:
    """Stateless: adds norm_key, bare_key and norm_version."""
    return stream.withColumn("norm_key", normalize(text)).withColumn("bare_key", strip_qualifiers("norm_key")).withColumn("norm_version", F.lit(NORM_VERSION))


def look_up(stream: DataFrame, localities: DataFrame, text: str) -> DataFrame:
    """Stream-static left join on the plain key, then on the key without qualifiers.

    ``localities``: norm_key, locality_id, one row per key.
    """
    names = localities.select(F.col("norm_key").alias("k"), "locality_id")
    plain = names.select(F.col("k").alias("norm_key"), F.col("locality_id").alias("plain_id"))
    bare = names.select(F.col("k").alias("bare_key"), F.col("locality_id").alias("bare_id"))
    met = with_keys(stream, text).join(plain, "norm_key", "left").join(bare, "bare_key", "left")
    return met.withColumn("locality_id", F.coalesce("plain_id", "bare_id")).drop("plain_id", "bare_id")


def counts_by_window(stream: DataFrame, time: str, key: str, width: str = "10 minutes", delay: str = "30 minutes") -> DataFrame:
    """How often each key is asked for, per window; later rows than ``delay`` are left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), key).count()


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to Parquet; with ``once`` all that is there, then it ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
