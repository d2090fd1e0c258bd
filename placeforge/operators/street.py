"""Street gazetteer: variants, one canonical form per key, and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeforge.functions.text import blank_to_null, normalize
from placeforge.schemas import COORDINATE, PRECISE, SUM

KEY = ["state", "locality", "postcode", "street_key"]
FORM = ["street_name", "street_type", "street_suffix"]


def decimal_or_null(c: str, kind=PRECISE) -> Column:
    """A coordinate held as text; blank is null, never zero."""
    return blank_to_null(c).cast(kind)


def has_postcode(c: Column | str = "postcode") -> Column:
    """Four digits before any padding; null has none."""
    return F.coalesce(F.trim(c), F.lit("")).rlike(r"\A[0-9]{4}\z")


def usable_addresses(addresses: DataFrame) -> DataFrame:
    """Addresses with street, state, locality and a four-digit postcode."""
    named = [blank_to_null(c).isNotNull() for c in ("street_name", "state", "locality_name")]
    return addresses.where(named[0] & named[1] & named[2] & has_postcode())


def variants(addresses: DataFrame) -> DataFrame:
    """Counts and coordinate sums for each way in which a street key is split into name, type and suffix.

    The sums of latitudes and longitudes take what is there; ``geo_n`` counts
    addresses that have both.
    """
    up = lambda c: F.upper(F.trim(c))
    rows = usable_addresses(addresses).select(
        up("state").alias("state"),
        up("locality_name").alias("locality"),
        F.lpad(F.trim("postcode"), 4, "0").alias("postcode"),
        F.upper(F.trim(F.concat_ws(" ", F.trim("street_name"), blank_to_null("street_type"), blank_to_null("street_suffix")))).alias("street_key"),
        up("street_name").alias("street_name"),
        F.upper(F.coalesce(F.trim("street_type"), F.lit(""))).alias("street_type"),
        F.upper(F.coalesce(F.trim("street_suffix"), F.lit(""))).alias("street_suffix"),
        decimal_or_null("latitude").alias("lat"),
        decimal_or_null("longitude").alias("lng"),
    )
    return rows.groupBy(*KEY, *FORM).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("lat").cast(SUM).alias("lat_sum"),
        F.sum("lng").cast(SUM).alias("lng_sum"),
        F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("geo_n"),
    )


def ranked(variant: DataFrame) -> DataFrame:
    """Adds ``rank``: the canonical form has 1.  Most addresses, then a typed form, then the longest type, then the name."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("n"), F.when(F.col("street_type") == "", 1).otherwise(0), F.length("street_type").desc(), "street_name", "street_type")
    return variant.withColumn("rank", F.row_number().over(order))


def canonical(variant: DataFrame, corrected: bool = False) -> DataFrame:
    """One row per key: the canonical form, all addresses, the centroid.

    Sums and ranks come from one pass over the keys' variants, in one shuffle,
    in place of a join with the winners.  The centroid divides by the addresses
    that have both coordinates though the sums may hold more; ``corrected``
    needs ``lat_n`` and ``lng_n`` of ``counted_variants`` and divides by those.
    """
    lat_n, lng_n = ("lat_n", "lng_n") if corrected else ("geo_n", "geo_n")
    whole = Window.partitionBy(*KEY)
    total = lambda c: F.sum(c).over(whole)
    mean = lambda s, n: (total(s) / F.nullif(total(n), F.lit(0))).cast(COORDINATE)
    return (
        ranked(variant)
        .withColumns({"address_count": total("n"), "lat": mean("lat_sum", lat_n), "lng": mean("lng_sum", lng_n)})
        .where("rank = 1")
        .select(*KEY, *FORM, "address_count", "lat", "lng")
    )


def counted_variants(addresses: DataFrame) -> DataFrame:
    """Variants whose coordinate sums and counts cover addresses with both coordinates only."""
    both = decimal_or_null("latitude").isNotNull() & decimal_or_null("longitude").isNotNull()
    complete = addresses.withColumns({c: F.when(both, F.col(c)) for c in ("latitude", "longitude")})
    return variants(complete).withColumns({"lat_n": F.col("geo_n"), "lng_n": F.col("geo_n")})


def with_norm_key(streets: DataFrame) -> DataFrame:
    """Adds the normal form of ``street_key``, which stays as it is."""
    return streets.withColumn("street_norm_key", normalize("street_key"))


def discarded(variant: DataFrame) -> DataFrame:
    """Variants that lost their key: candidates for street aliases."""
    return ranked(variant).where("rank > 1").drop("rank")


# -- diagnostics on the source --------------------------------------------------


def _raw_key() -> Column:
    return F.upper(F.concat_ws(" ", "street_name", F.nullif("street_type", F.lit("")), F.nullif("street_suffix", F.lit(""))))


def key_forms(addresses: DataFrame, state: str, locality: str, postcode: str, street_key: str) -> DataFrame:
    """The forms of one street key with their counts."""
    own = addresses.where((F.col("state") == state) & (F.col("locality_name") == locality) & (F.col("postcode") == postcode) & (_raw_key() == street_key))
    return own.groupBy(*FORM).agg(F.count(F.lit(1)).alias("n"))


def collisions(addresses: DataFrame) -> DataFrame:
    """Street keys with more than one form; the forms in the order of their names.  Columns as they are, untrimmed."""
    named = addresses.where(blank_to_null("street_name").isNotNull())
    typed, suffix = (F.coalesce(c, F.lit("")) for c in ("street_type", "street_suffix"))
    form = F.struct(F.col("street_name").alias("a"), typed.alias("b"), suffix.alias("c"))
    sets = named.groupBy("state", "locality_name", "postcode", _raw_key().alias("street_key")).agg(F.array_sort(F.collect_set(form)).alias("forms"))
    show = F.transform("forms", lambda f: F.concat(F.lit("["), f["a"], F.lit("|"), f["b"], F.lit("|"), f["c"], F.lit("]")))
    return sets.where(F.size("forms") > 1).select("state", "locality_name", "postcode", "street_key", F.size("forms").cast("long").alias("variants"), F.array_join(show, " ").alias("forms"))


def worst_collisions(addresses: DataFrame, limit: int = 50) -> DataFrame:
    """The keys with the most forms; ties by key."""
    key = ["state", "locality_name", "postcode", "street_key"]
    return collisions(addresses).orderBy(F.desc("variants"), *[F.asc_nulls_first(c) for c in key]).limit(limit)


def blank_coordinates(addresses: DataFrame) -> DataFrame:
    return addresses.agg(F.count_if(blank_to_null("latitude").isNull() | blank_to_null("longitude").isNull()).alias("blank_or_null_coords"))


# -- verification -----------------------------------------------------------------


def conservation(streets: DataFrame, addresses: DataFrame) -> DataFrame:
    """Addresses of the gazetteer against usable ones of the source: one row."""
    have = streets.agg(F.sum("address_count").alias("gazetteer_addresses"))
    return have.join(usable_addresses(addresses).agg(F.count(F.lit(1)).alias("source_addresses")))


def summary(streets: DataFrame) -> DataFrame:
    place = F.concat_ws("|", "state", "locality", "postcode")
    return streets.agg(F.count(F.lit(1)).alias("street_rows"), F.countDistinct(place).alias("localities"), F.count_if(F.col("lat").isNull()).alias("rows_without_geometry"))


def out_of_bounds(places: DataFrame) -> DataFrame:
    """Centroids outside latitude -44 to -9, longitude 112 to 154.  State OT is left out; a lone latitude within bounds is not counted."""
    outside = ~F.col("lat").between(-44, -9) | ~F.col("lng").between(112, 154)
    return places.where((F.col("state") != "OT") & F.col("lat").isNotNull() & outside).agg(F.count(F.lit(1)).alias("out_of_bounds"))


def merged_keys(variant: DataFrame) -> DataFrame:
    return variant.groupBy(*KEY).count().where("count > 1").agg(F.count(F.lit(1)).alias("merged_keys"))


def spot(streets: DataFrame, **key: str) -> DataFrame:
    for name, value in key.items():
        streets = streets.where(F.col(name) == value)
    return streets
