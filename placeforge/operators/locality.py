"""Locality gazetteer: address centroids, postcode centroids, postal rows, and their merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeforge.functions.text import NORM_VERSION, blank_to_null, normalize
from placeforge.operators.street import decimal_or_null, has_postcode
from placeforge.schemas import COORDINATE

KEY = ["state", "locality", "postcode"]
AREAS = ["delivery_type", "sa2_name", "sa3_name", "sa4_name", "lga_name", "remoteness"]


def from_addresses(addresses: DataFrame) -> DataFrame:
    """Localities of principal addresses with mean coordinates and counts.

    The postcode is tested before it is padded, so three digits do not count.
    """
    principal = F.coalesce(F.trim("alias_principal"), F.lit("")) != "ALIAS"
    rows = addresses.where(has_postcode() & blank_to_null("locality_name").isNotNull() & blank_to_null("state").isNotNull() & principal)
    named = rows.select(
        F.lpad(F.trim("postcode"), 4, "0").alias("postcode"), F.upper(F.trim("locality_name")).alias("locality"), F.upper(F.trim("state")).alias("state"),
        decimal_or_null("latitude").alias("la"), decimal_or_null("longitude").alias("ln"),
    )
    return named.groupBy(*KEY).agg(
        F.avg("la").cast(COORDINATE).alias("lat"), F.avg("ln").cast(COORDINATE).alias("lng"), F.count(F.lit(1)).alias("address_count"),
        F.count("la").alias("lat_n"), F.count("ln").alias("lng_n"),
    )


def postcode_centroids(localities: DataFrame, corrected: bool = False) -> DataFrame:
    """Means of the localities' centroids weighted by addresses.

    A locality without a coordinate still weighs in the divisor, which draws
    the mean to zero; ``corrected`` weighs with the addresses that have one.
    """
    weight = {"lat": "lat_n", "lng": "lng_n"} if corrected else {"lat": "address_count", "lng": "address_count"}
    mean = lambda c: (F.sum(F.col(c) * F.col(weight[c])) / F.nullif(F.sum(weight[c]), F.lit(0))).cast(COORDINATE)
    return localities.groupBy("state", "postcode").agg(mean("lat").alias("lat"), mean("lng").alias("lng"))


def postal(postcodes: DataFrame) -> DataFrame:
    """The first row by id of each postal place.  The postcode is padded, and cut to four, before it is tested."""
    up = lambda c: F.upper(F.trim(c))
    keyed = postcodes.withColumns({"k_postcode": F.lpad(F.trim("postcode"), 4, "0"), "k_locality": up("locality"), "k_state": up("state")})
    good = keyed.where(F.col("k_postcode").rlike(r"\A[0-9]{4}\z") & (F.col("k_locality") != "") & (F.col("k_state") != ""))
    first = Window.partitionBy("k_postcode", "k_locality", "k_state").orderBy("id")
    rows = good.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    coordinate = lambda c: decimal_or_null(c).cast(COORDINATE)
    return rows.select(
        F.col("k_state").alias("state"), F.col("k_locality").alias("locality"), F.col("k_postcode").alias("postcode"),
        coordinate("lat_precise").alias("lat"), coordinate("long_precise").alias("lng"), blank_to_null("type").alias("delivery_type"),
        *[blank_to_null(c).alias(c) for c in ("sa2_name", "sa3_name", "sa4_name", "lga_name")], blank_to_null("region").alias("remoteness"),
    )


def merge(localities: DataFrame, centroids: DataFrame, posts: DataFrame, snapshot_id: str | None = None) -> DataFrame:
    """All places of either source, in one full outer join.

    Places with addresses are ``gnaf`` even without coordinates; others are
    postal only, ``auspost`` where they have coordinates and ``none`` elsewhere.
    """
    g = localities.select(*KEY, F.col("lat").alias("g_lat"), F.col("lng").alias("g_lng"), "address_count")
    a = posts.select(*KEY, F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), *AREAS, F.lit(True).alias("in_post"))
    p = centroids.select("state", "postcode", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    own = F.col("address_count").isNotNull()
    both = g.join(a, KEY, "full").join(p, ["state", "postcode"], "left")
    choose = lambda x, y: F.when(own, F.col(x)).otherwise(F.col(y))
    return both.select(
        *KEY, choose("g_lat", "a_lat").alias("lat"), choose("g_lng", "a_lng").alias("lng"),
        choose("p_lat", "a_lat").alias("postcode_lat"), choose("p_lng", "a_lng").alias("postcode_lng"),
        F.when(own, "gnaf").when(F.col("a_lat").isNull(), "none").otherwise("auspost").alias("geo_source"),
        F.coalesce("address_count", F.lit(0)).cast("long").alias("address_count"),
        own.alias("in_gnaf"), F.coalesce("in_post", F.lit(False)).alias("in_auspost"), (~own).alias("is_postal_only"), *AREAS,
        F.lit(NORM_VERSION).alias("norm_version"), (F.lit(snapshot_id) if snapshot_id else F.date_format(F.current_date(), "yyyy-MM")).alias("snapshot_id"),
    )


def postal_only(posts: DataFrame, localities: DataFrame) -> DataFrame:
    """Postal places that no address has."""
    return posts.join(localities.select(*KEY), KEY, "left_anti")


def merge_by_union(localities: DataFrame, centroids: DataFrame, posts: DataFrame, snapshot_id: str | None = None) -> DataFrame:
    """The same places by a left join and an anti join; ``merge`` does it in one."""
    known = merge(localities, centroids, posts.join(localities.select(*KEY), KEY, "left_semi"), snapshot_id)
    alone = merge(localities.limit(0), centroids, postal_only(posts, localities), snapshot_id)
    return known.unionByName(alone)


def with_ids(localities: DataFrame) -> DataFrame:
    """Adds ``locality_id``, a hash of the key: the same in every build, without a global order."""
    return localities.select(F.xxhash64(*KEY).alias("locality_id"), "*")


def with_street_counts(localities: DataFrame, streets: DataFrame) -> DataFrame:
    """Adds ``street_count``, 0 where there are no streets."""
    counts = streets.groupBy(*KEY).agg(F.count(F.lit(1)).alias("street_count"))
    return localities.join(counts, KEY, "left").withColumn("street_count", F.coalesce("street_count", F.lit(0)))


def with_norm_key(localities: DataFrame) -> DataFrame:
    return localities.withColumn("norm_key", normalize("locality"))


# -- verification -----------------------------------------------------------------


def provenance(localities: DataFrame) -> DataFrame:
    return localities.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("in_gnaf").alias("from_gnaf"), F.count_if("in_auspost").alias("from_auspost"),
        F.count_if("is_postal_only").alias("postal_only"), F.count_if(F.col("geo_source") == "none").alias("no_geometry"),
    )


def ambiguous(localities: DataFrame, limit: int = 40, least: int = 2) -> DataFrame:
    """Names that several states have, most states first."""
    states = localities.groupBy("locality").agg(F.array_sort(F.collect_set("state")).alias("s"))
    many = states.where(F.size("s") >= least).select("locality", F.size("s").cast("long").alias("states"), F.array_join("s", ",").alias("state_list"))
    return many.orderBy(F.desc("states"), "locality").limit(limit)


def spots(localities: DataFrame, names: list[str]) -> DataFrame:
    return localities.where(F.col("locality").isin(names)).orderBy("state", "postcode", "locality")
