"""The queries of the gazetteer engine over the test tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeforge.functions import text
from placeforge.operators import alias, keys, locality, resolve, street
from placeforge.plans.build import Build, from_test_tables
from placeforge.schemas import GRANULARITY
from placeforge.sources.tables import as_json, read_parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison with engines that divide as doubles."""
    return df.select(*[F.col(f.name).cast("double") if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema.fields])


def _query(f: Callable[[Build], DataFrame]) -> Query:
    """Registers a query on a build of the test tables."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _plain(f(from_test_tables(spark, folder)))

    QUERIES[f.__name__] = run
    return run


def _settled_query(f: Callable[[Build], DataFrame]) -> Query:
    """Registers a query that uses the build's tables more than once."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _plain(f(from_test_tables(spark, folder, settled=True)))

    QUERIES[f.__name__] = run
    return run


def _table_query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@_query
def street_variants(b: Build) -> DataFrame:
    return b.variants


@_query
def street_canonical(b: Build) -> DataFrame:
    return b.streets


@_query
def street_norm_keys(b: Build) -> DataFrame:
    return street.with_norm_key(b.streets).select("state", "locality", "postcode", "street_key", "street_norm_key")


@_query
def street_discarded(b: Build) -> DataFrame:
    return street.discarded(b.variants)


@_query
def street_collisions(b: Build) -> DataFrame:
    return street.collisions(b.addresses)


@_query
def street_worst_collisions(b: Build) -> DataFrame:
    return street.worst_collisions(b.addresses)


@_query
def street_key_forms(b: Build) -> DataFrame:
    return street.key_forms(b.addresses, "AFR", "NATION_0", "2000", "SMALL RING")


@_query
def street_conservation(b: Build) -> DataFrame:
    return street.conservation(b.streets, b.addresses)


@_query
def street_merged_keys(b: Build) -> DataFrame:
    return street.merged_keys(b.variants)


@_query
def street_summary(b: Build) -> DataFrame:
    return street.summary(b.streets)


@_query
def street_out_of_bounds(b: Build) -> DataFrame:
    return street.out_of_bounds(b.streets)


@_query
def street_spot(b: Build) -> DataFrame:
    return street.spot(b.streets, state="AFR", locality="NATION_0", street_key="SMALL RING")


@_query
def blank_coordinates(b: Build) -> DataFrame:
    return street.blank_coordinates(b.addresses)


@_query
def locality_from_addresses(b: Build) -> DataFrame:
    return b.with_addresses.drop("lat_n", "lng_n")


@_query
def postcode_centroid(b: Build) -> DataFrame:
    return locality.postcode_centroids(b.with_addresses)


@_query
def postal_dedupe(b: Build) -> DataFrame:
    return b.posts


@_query
def postal_only_anti(b: Build) -> DataFrame:
    return locality.postal_only(b.posts, b.with_addresses)


@_query
def locality_merge(b: Build) -> DataFrame:
    return locality.merge_by_union(b.with_addresses, locality.postcode_centroids(b.with_addresses), b.posts, b.snapshot_id)


@_query
def locality_full_outer(b: Build) -> DataFrame:
    return b.places.drop("locality_id")


@_query
def locality_street_counts(b: Build) -> DataFrame:
    return b.localities.select("state", "locality", "postcode", "street_count")


@_query
def locality_norm_keys(b: Build) -> DataFrame:
    return locality.with_norm_key(b.places).select("state", "locality", "postcode", "norm_key")


@_query
def locality_out_of_bounds(b: Build) -> DataFrame:
    return street.out_of_bounds(b.places)


@_query
def locality_spots(b: Build) -> DataFrame:
    names = ["NATION_1", "NATION_2 BC", "NATION_3", "NATION_9"]
    return locality.spots(b.places, names).select("state", "locality", "postcode", "address_count", "in_gnaf", "in_auspost", "is_postal_only")


@_query
def provenance_totals(b: Build) -> DataFrame:
    return locality.provenance(b.places)


@_query
def ambiguous_localities(b: Build) -> DataFrame:
    return locality.ambiguous(b.places)


def _targets(b: Build, aliases: DataFrame) -> DataFrame:
    """Aliases with their locality's key in place of its id."""
    return aliases.join(b.places.select("locality_id", "state", "locality", "postcode"), "locality_id").drop("locality_id", "alias_id")


@_query
def alias_principal(b: Build) -> DataFrame:
    return _targets(b, alias.from_principals(b.addresses, b.places))


@_query
def alias_state_bucket(b: Build) -> DataFrame:
    return _targets(b, alias.from_state_bucket(b.bucket, b.places))


@_query
def alias_postal_variant(b: Build) -> DataFrame:
    return _targets(b, alias.from_postal_variants(b.posts, b.places, b.with_addresses))


@_settled_query
def alias_all_precedence(b: Build) -> DataFrame:
    return _targets(b, b.aliases)


@_settled_query
def alias_collisions(b: Build) -> DataFrame:
    return alias.collisions(b.aliases, limit=None)


@_settled_query
def alias_worst_collisions(b: Build) -> DataFrame:
    return alias.collisions(b.aliases)


@_settled_query
def alias_manual_export(b: Build) -> DataFrame:
    manual = b.places.where("is_postal_only").select(F.concat(F.lit("THE "), "locality").alias("alias_display"), "locality", "state", "postcode", F.lit(1.0).alias("confidence"))
    return alias.export_manual(alias.from_manual(manual, b.places), b.places)


@_table_query
def normalize_documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_parquet(spark, folder, "documents").select("doc_id", text.normalize("text").alias("norm"))


def qualified_names(spark: SparkSession, folder: str) -> DataFrame:
    """id, name: places with up to two qualifiers on either side."""
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    key = F.col("c_custkey")
    front, back = text.QUALIFIER_PREFIXES, text.QUALIFIER_SUFFIXES
    place = F.when(key % 29 != 0, F.concat(F.lit("PLACE "), F.col("c_nationkey").cast("string")))
    parts = [pick(front, key % 13), pick(front, F.floor(key / 13) % 12), place, pick(back, F.floor(key / 7) % 12), pick(back, key % 17)]
    return read_parquet(spark, folder, "customer").select(key.alias("id"), F.concat_ws(" ", *parts).alias("name"))


@_table_query
def strip_qualifiers_names(spark: SparkSession, folder: str) -> DataFrame:
    return qualified_names(spark, folder).withColumn("stripped", text.strip_qualifiers("name"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """id, text: address-like lines."""
    orders, customer = read_parquet(spark, folder, "orders"), read_parquet(spark, folder, "customer")
    nation, region, part = (read_parquet(spark, folder, t) for t in ("nation", "region", "part"))
    key = F.col("o_orderkey")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(part, F.col("p_partkey") == key % 200)
    state = F.when(key % 2 == 0, F.substring("r_name", 1, 3))
    return rows.select(key.alias("id"), F.concat_ws(" ", (key % 400).cast("string"), "p_name", "n_name", state).alias("text"))


@_table_query
def token_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    grams = text.ngrams(text.tokens(text.normalize("text")))
    return _texts(spark, folder).select("id", F.explode(grams).alias("g")).select("id", "g.start", "g.end", "g.span")


@_table_query
def cache_keys(spark: SparkSession, folder: str) -> DataFrame:
    return read_parquet(spark, folder, "documents").select("doc_id", text.cache_key("loc", "text", F.lit("AUS"), F.col("lang")).alias("cache_key"))


@_table_query
def granularity_at_least(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(*map(F.lit, GRANULARITY))
    pairs = spark.range(1).select(F.explode(names).alias("got")).select("got", F.explode(names).alias("want"))
    return pairs.select("got", "want", text.at_least(F.col("got"), F.col("want"), GRANULARITY).alias("ok"))


@_settled_query
def key_health(b: Build) -> DataFrame:
    tables = {"aliases": b.aliases, "localities": b.localities, "streets": b.streets, "unresolved": None}
    return keys.health(tables, {"aliases": "alias_norm_key", "localities": "norm_key"})


def _stale(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a key of an older version, or none."""
    docs = read_parquet(spark, folder, "documents")
    due = F.col("doc_id") % 3 == 0
    return docs.select("doc_id", "source", F.when(due, "").otherwise("OLD").alias("norm_key"), F.when(due, "1").otherwise("0").alias("norm_version"))


@_table_query
def key_backfill(spark: SparkSession, folder: str) -> DataFrame:
    return keys.backfill(_stale(spark, folder), "source", "norm_key").drop("source")


@_table_query
def key_verify(spark: SparkSession, folder: str) -> DataFrame:
    return keys.verify({"documents": (_stale(spark, folder), "norm_key")})


@_query
def address_json(b: Build) -> DataFrame:
    return as_json(b.streets.select("state", "locality", "postcode", "street_key", "address_count"))


@_table_query
def resolve_exact(spark: SparkSession, folder: str) -> DataFrame:
    b = from_test_tables(spark, folder)
    key = F.col("doc_id")
    name = F.concat(F.when(key % 2 == 0, "Greater Nation_").otherwise("nation_"), (key % 31).cast("string"))
    asked = read_parquet(spark, folder, "documents").select(key.alias("id"), text.normalize(name).alias("k")).withColumn("b", text.strip_qualifiers("k"))
    names = locality.with_norm_key(b.places).groupBy("norm_key").agg(F.sum("address_count").alias("n"))
    plain = names.select(F.col("norm_key").alias("k"), F.col("n").alias("n1"), F.col("norm_key").alias("k1"))
    bare = names.select(F.col("norm_key").alias("b"), F.col("n").alias("n2"), F.col("norm_key").alias("k2"))
    return asked.join(plain, "k", "left").join(bare, "b", "left").select("id", F.coalesce("k1", "k2").alias("key"), F.coalesce("n1", "n2").alias("n"))


def _keys(b: Build) -> DataFrame:
    """key, locality's key, confidence, kind of all localities and aliases."""
    own = b.places.select(text.normalize("locality").alias("key"), "state", "locality", "postcode", F.lit(1.0).alias("confidence"), F.lit(1).alias("kind"))
    other = _targets(b, b.aliases).select(F.col("alias_norm_key").alias("key"), "state", "locality", "postcode", F.col("confidence").cast("double"), F.lit(2).alias("kind"))
    return own.unionByName(other)


@_table_query
def resolve_longest_span(spark: SparkSession, folder: str) -> DataFrame:
    asked = resolve.prepare(_texts(spark, folder))
    return resolve.longest_spans(asked.withColumn("stripped", F.col("norm")), _keys(from_test_tables(spark, folder, settled=True)))


@_table_query
def resolve_alias_scored(spark: SparkSession, folder: str) -> DataFrame:
    asked = resolve.prepare(_texts(spark, folder)).withColumn("stripped", F.col("norm"))
    hits = resolve.spans(asked).join(_keys(from_test_tables(spark, folder, settled=True)), F.col("span") == F.col("key"))
    order = Window.partitionBy("id").orderBy((F.col("end") - F.col("start")).desc(), F.desc("confidence"), "kind", "state", "locality", "postcode")
    return hits.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("id", "locality", "state", "postcode", "confidence")


@_table_query
def resolve_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    part = read_parquet(spark, folder, "part")
    name, key = F.col("p_name"), F.col("p_partkey") % 3
    changed = F.when(key == 0, F.concat(name, F.lit("s"))).when(key == 1, F.replace(name, F.lit("e"), F.lit("i"))).otherwise(F.concat(name, F.lit("ing on")))
    asked = part.select(F.col("p_partkey").alias("id"), text.normalize(changed).alias("norm"))
    return resolve.fuzzy(asked, part.select(text.normalize("p_name").alias("key")), 85)


@_table_query
def resolve_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The whole resolver over the address-like lines; its rules are no SQL, so it has no oracle."""
    b = from_test_tables(spark, folder, settled=True)
    nation, region = read_parquet(spark, folder, "nation"), read_parquet(spark, folder, "region")
    cities = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("CITY "), F.col("n_nationkey").cast("string")).alias("name"), F.substring("r_name", 1, 3).alias("admin1"), F.lit("AUS").alias("country"),
        (F.col("n_nationkey") * 1000).alias("population"), F.lit(-30.0).alias("lat"), F.lit(140.0).alias("lng"),
    )
    countries = spark.range(1).select(F.lit("Australia").alias("name"), F.lit("AU").alias("alpha2"), F.lit("AUS").alias("alpha3"))
    states = region.select(F.col("r_name").alias("name"), F.substring("r_name", 1, 3).alias("code"))
    g = resolve.Gazetteers(b.localities, b.aliases, b.streets, cities, countries, states)
    return resolve.resolve_once(_texts(spark, folder), g).select("id", "normalized", "granularity", "confidence", "match_method", "locality", "postcode", F.col("admin1.code").alias("admin1"))
