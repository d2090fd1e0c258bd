"""Table and document schemas, and the values of enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values, from the most to the least specific.
GRANULARITY = ("unit", "address", "street", "postcode", "locality", "admin1", "city", "country", "unresolved")
#: Fixed values.
MATCH_METHODS = (
    "cache", "gnaf_exact", "gnaf_street_centroid", "locality_exact", "locality_alias", "locality_fuzzy", "postal_only",
    "city_exact", "city_fuzzy", "city_population_tiebreak", "country_bucket", "state_bucket", "none",
)
GEO_SOURCES = ("gnaf_property_centroid", "gnaf_street_centroid", "locality_centroid", "postcode_centroid", "city_point", "none")
LOCALITY_GEO_SOURCES = ("gnaf", "auspost", "none")
ALIAS_TYPES = ("gnaf_alias", "auspost_variant", "state_bucket", "abbrev", "manual")

#: Longest values of text columns.
WIDTHS = {"state": 3, "postcode": 4, "locality": 64, "street_key": 128, "street_name": 64, "street_type": 32, "street_suffix": 16, "alias_display": 96}

COORDINATE, PRECISE, SUM = T.DecimalType(10, 7), T.DecimalType(11, 8), T.DecimalType(24, 8)


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


ADDRESS = T.StructType(_strings("address_detail_pid", "principal_pid", "alias_principal", "state", "locality_name", "postcode", "street_name", "street_type", "street_suffix", "latitude", "longitude"))
POSTCODES = T.StructType([T.StructField("id", T.LongType()), *_strings("postcode", "locality", "state", "lat_precise", "long_precise", "type", "sa2_name", "sa3_name", "sa4_name", "lga_name", "region")])
STATE_BUCKET = T.StructType(_strings("value", "state"))
GOLDEN = T.StructType(_strings("input", "expected_granularity", "expected_country", "expected_admin1", "expected_locality", "note"))

RESPONSE = T.StructType([
    *_strings("query", "normalized"), T.StructField("resolved", T.BooleanType()), *_strings("granularity"), T.StructField("confidence", T.DoubleType()), *_strings("match_method"),
    T.StructField("country", T.StructType(_strings("name", "alpha2", "alpha3"))), T.StructField("admin1", T.StructType(_strings("name", "code"))), *_strings("locality", "postcode"),
    T.StructField("geo", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType()), *_strings("source")])),
    T.StructField("au_address", T.StructType(_strings(
        "address_detail_pid", "flat_type", "flat_number", "level_type", "level_number", "number_first", "number_last", "street_name", "street_type", "street_suffix",
        "locality_name", "state", "postcode", "mb_code", "alias_principal", "primary_secondary", "formatted"))),
    T.StructField("candidates", T.ArrayType(T.StructType([*_strings("label"), T.StructField("confidence", T.DoubleType()), *_strings("granularity", "country", "admin1", "locality", "reason")]))),
    T.StructField("warnings", T.ArrayType(T.StringType())), *_strings("norm_version", "snapshot_id"),
])
