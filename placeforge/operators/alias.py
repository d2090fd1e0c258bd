"""Locality aliases from four sources, with precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeforge.functions.text import NORM_VERSION, blank_to_null, normalize
from placeforge.operators.locality import KEY
from placeforge.schemas import WIDTHS

#: Kinds in the order in which they are written (the first one stays), and score multipliers.
PRECEDENCE = (("gnaf_alias", "1.00"), ("state_bucket", "0.95"), ("auspost_variant", "0.80"), ("manual", "1.00"))
COLUMNS = ["alias_display", "locality_id", "alias_type", "confidence"]


def _kind(rows: DataFrame, kind: str) -> DataFrame:
    """Distinct aliases of one kind, cut to the column's width."""
    display = F.substring("alias_display", 1, WIDTHS["alias_display"]).alias("alias_display")
    return rows.select(display, "locality_id").distinct().select("alias_display", "locality_id", F.lit(kind).alias("alias_type"), F.lit(dict(PRECEDENCE)[kind]).cast("decimal(3,2)").alias("confidence"))


def from_principals(addresses: DataFrame, localities: DataFrame) -> DataFrame:
    """An alias address's locality names the locality of its principal, where the two differ.

    Both sides of the self join are cut to a few columns and the alias side to
    alias rows first; principals lose what is no locality right after.
    """
    up = lambda c: F.upper(F.trim(c))
    other = addresses.where((F.coalesce(F.trim("alias_principal"), F.lit("")) == "ALIAS") & blank_to_null("locality_name").isNotNull())
    other = other.select("principal_pid", up("locality_name").alias("alias_display")).where("principal_pid IS NOT NULL").distinct()
    main = addresses.select(F.col("address_detail_pid").alias("principal_pid"), up("state").alias("state"), up("locality_name").alias("locality"), F.lpad(F.trim("postcode"), 4, "0").alias("postcode"))
    met = other.join(main, "principal_pid").where("alias_display <> locality").select("alias_display", *KEY).distinct()
    return _kind(met.join(localities.select("locality_id", *KEY), KEY), "gnaf_alias")


def from_state_bucket(bucket: DataFrame, localities: DataFrame) -> DataFrame:
    """``STATE LOCALITY`` names the locality of that state in each of its postcodes."""
    value, state = F.trim("value"), F.trim("state")
    rest = F.substring(value, F.length(state) + 2, F.length(value))
    fits = F.startswith(F.upper(value), F.concat(F.upper(state), F.lit(" "))) & (F.length(value) > F.length(state) + 1)
    named = bucket.where(fits).select(F.upper(value).alias("alias_display"), F.upper(state).alias("state"), F.upper(F.trim(rest)).alias("locality"))
    return _kind(named.join(localities.select("locality_id", "state", "locality"), ["state", "locality"]), "state_bucket")


def from_postal_variants(posts: DataFrame, localities: DataFrame, with_addresses: DataFrame) -> DataFrame:
    """A postal spelling that no address has names every locality with addresses in its postcode."""
    unknown = posts.join(with_addresses.select(*KEY), KEY, "left_anti").select("state", "postcode", F.col("locality").alias("alias_display"))
    known = localities.where("in_gnaf").select("locality_id", "state", "postcode", "locality")
    return _kind(unknown.join(known, ["state", "postcode"]).where("locality <> alias_display"), "auspost_variant")


def from_manual(manual: DataFrame, localities: DataFrame) -> DataFrame:
    """Hand-kept aliases (alias_display, state, locality, postcode, confidence), applied anew in each build."""
    met = manual.join(localities.select("locality_id", *KEY), KEY)
    return met.select(F.substring("alias_display", 1, WIDTHS["alias_display"]).alias("alias_display"), "locality_id", F.lit("manual").alias("alias_type"), F.col("confidence").cast("decimal(3,2)").alias("confidence"))


def combine(*kinds: DataFrame) -> DataFrame:
    """One row per alias and locality: the kind that comes first in ``PRECEDENCE``."""
    rows = kinds[0]
    for more in kinds[1:]:
        rows = rows.unionByName(more)
    rank = F.array_position(F.array(*[F.lit(k) for k, _ in PRECEDENCE]), F.col("alias_type"))
    order = Window.partitionBy("alias_display", "locality_id").orderBy(rank, F.desc("confidence"))
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(*COLUMNS)


def finish(aliases: DataFrame) -> DataFrame:
    """Adds alias_id (a hash of the key), alias_norm_key and norm_version."""
    return aliases.select(F.xxhash64("alias_display", "locality_id").alias("alias_id"), normalize("alias_display").alias("alias_norm_key"), *COLUMNS, F.lit(NORM_VERSION).alias("norm_version"))


def collisions(aliases: DataFrame, limit: int | None = 40) -> DataFrame:
    """Aliases of several localities, most first; ties by name."""
    many = aliases.groupBy("alias_display").agg(F.count(F.lit(1)).alias("targets")).where("targets > 1")
    return many if limit is None else many.orderBy(F.desc("targets"), "alias_display").limit(limit)


def export_manual(aliases: DataFrame, localities: DataFrame) -> DataFrame:
    """Manual aliases in the form that ``from_manual`` takes."""
    own = aliases.where("alias_type = 'manual'").select("alias_display", "locality_id", "confidence")
    return own.join(localities.select("locality_id", *KEY), "locality_id").select("alias_display", "locality", "state", "postcode", "confidence")
