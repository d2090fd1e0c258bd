"""Address-shaped views over the star-schema test tables (FIXTURES.md, section 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeforge.sources.tables import read_parquet


def _places(spark: SparkSession, folder: str) -> DataFrame:
    """nation with region: 25 rows."""
    nation, region = read_parquet(spark, folder, "nation"), read_parquet(spark, folder, "region")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.substring("r_name", 1, 3).alias("state"))


def _s(c: Column) -> Column:
    return c.cast("string")


def address_ref(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_parquet(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = read_parquet(spark, folder, "customer").select("c_custkey", "c_nationkey")
    part = read_parquet(spark, folder, "part").where("p_partkey < 200").select("p_partkey", "p_name")  # 200 rows are used
    key, cust, nation = F.col("o_orderkey"), F.col("o_custkey"), F.col("n_nationkey")
    rows = (
        orders.join(customer, cust == F.col("c_custkey"))
        .join(F.broadcast(_places(spark, folder)), F.col("c_nationkey") == nation)
        .join(F.broadcast(part), F.col("p_partkey") == key % 200)
    )
    words = F.split("p_name", " ")
    alias, whole = key % 5 == 4, key % 3 == 0
    thousandth = F.lpad(_s(key % 1000), 3, "0")
    return rows.select(
        F.concat(F.lit("GA"), _s(key)).alias("address_detail_pid"),
        F.when(alias, F.concat(F.lit("GA"), _s(key - 1))).alias("principal_pid"),
        F.when(alias, "ALIAS").otherwise("PRINCIPAL").alias("alias_principal"),
        "state",
        F.when(cust % 11 == 1, F.concat(F.lit("  "), F.lower("n_name"), F.lit(" "))).when(cust % 11 == 2, "").otherwise(F.col("n_name")).alias("locality_name"),
        F.when(key % 17 == 0, None).when(key % 13 == 0, _s(800 + nation)).otherwise(_s(2000 + nation * 10 + cust % 3)).alias("postcode"),
        F.when(whole, F.col("p_name")).otherwise(F.get(words, F.lit(0))).alias("street_name"),
        F.when(whole, "").otherwise(F.get(words, F.lit(1))).alias("street_type"),
        F.when(key % 23 == 0, "N").alias("street_suffix"),
        F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("-"), _s(10 + cust % 30), F.lit("."), thousandth)).alias("latitude"),
        F.when((key % 7 == 0) | (key % 19 == 0), " ").otherwise(F.concat(_s(113 + cust % 40), F.lit("."), thousandth)).alias("longitude"),
    )


def postcodes(spark: SparkSession, folder: str) -> DataFrame:
    customer = read_parquet(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = customer.join(F.broadcast(_places(spark, folder)), F.col("c_nationkey") == F.col("n_nationkey"))
    key, nation = F.col("c_custkey"), F.col("n_nationkey")
    return rows.select(
        key.alias("id"),
        F.when(key % 9 == 0, _s(800 + nation)).otherwise(_s(2000 + nation * 10 + key % 3)).alias("postcode"),
        F.when(key % 6 == 0, F.concat("n_name", F.lit(" BC"))).when(key % 6 == 1, F.lower("n_name")).otherwise(F.col("n_name")).alias("locality"),
        "state",
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("-"), _s(10 + key % 30), F.lit(".5"))).alias("lat_precise"),
        F.when(key % 4 == 0, "").otherwise(F.concat(_s(113 + key % 40), F.lit(".25"))).alias("long_precise"),
        F.col("c_mktsegment").alias("type"),
        F.concat(F.lit("SA2 "), _s(key % 50)).alias("sa2_name"),
        F.concat(F.lit("SA3 "), _s(key % 20)).alias("sa3_name"),
        F.when(key % 5 == 0, " ").otherwise(F.concat(F.lit("SA4 "), _s(key % 8))).alias("sa4_name"),
        F.concat(F.lit("LGA "), _s(key % 12)).alias("lga_name"),
        F.concat(F.lit("R"), _s(key % 5 + 1)).alias("region"),
    )


def state_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return _places(spark, folder).select(F.concat("state", F.lit(" "), "n_name").alias("value"), "state")
