"""DuckDB SQL that gives the rows of ``placeforge.plans.queries``, written independently of the Spark plans.

Decimal results are compared as doubles.  DuckDB divides decimals as doubles, so
means are rounded here by whole numbers, half away from zero.
"""

from __future__ import annotations

from placeforge.functions.text import QUALIFIER_PREFIXES, QUALIFIER_SUFFIXES, folding

ADDRESS = """
address_ref AS (
  SELECT 'GA' || o_orderkey AS address_detail_pid,
    CASE WHEN o_orderkey % 5 = 4 THEN 'GA' || (o_orderkey - 1) END AS principal_pid,
    CASE WHEN o_orderkey % 5 = 4 THEN 'ALIAS' ELSE 'PRINCIPAL' END AS alias_principal,
    substr(r_name, 1, 3) AS state,
    CASE o_custkey % 11 WHEN 1 THEN '  ' || lower(n_name) || ' ' WHEN 2 THEN '' ELSE n_name END AS locality_name,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN CAST(800 + n_nationkey AS VARCHAR)
      ELSE CAST(2000 + n_nationkey * 10 + o_custkey % 3 AS VARCHAR) END AS postcode,
    CASE WHEN o_orderkey % 3 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END AS street_name,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE split_part(p_name, ' ', 2) END AS street_type,
    CASE WHEN o_orderkey % 23 = 0 THEN 'N' END AS street_suffix,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '-' || (10 + o_custkey % 30) || '.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END AS latitude,
    CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 19 = 0 THEN ' ' ELSE (113 + o_custkey % 40) || '.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END AS longitude
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey JOIN part ON p_partkey = o_orderkey % 200
)"""

#: Coordinates as whole hundred-millionths.
VARIANT = (
    ADDRESS
    + """, usable AS (
  SELECT *, CAST(CAST(nullif(trim(latitude), '') AS DECIMAL(38,8)) * 100000000 AS HUGEINT) AS la,
    CAST(CAST(nullif(trim(longitude), '') AS DECIMAL(38,8)) * 100000000 AS HUGEINT) AS ln
  FROM address_ref
  WHERE nullif(trim(street_name), '') IS NOT NULL AND nullif(trim(state), '') IS NOT NULL
    AND nullif(trim(locality_name), '') IS NOT NULL AND regexp_full_match(coalesce(trim(postcode), ''), '[0-9]{4}')
), variant AS (
  SELECT upper(trim(state)) AS state, upper(trim(locality_name)) AS locality, lpad(trim(postcode), 4, '0') AS postcode,
    upper(trim(concat_ws(' ', trim(street_name), nullif(trim(street_type), ''), nullif(trim(street_suffix), '')))) AS street_key,
    upper(trim(street_name)) AS street_name, upper(coalesce(trim(street_type), '')) AS street_type, upper(coalesce(trim(street_suffix), '')) AS street_suffix,
    count(*) AS n, sum(la) AS la, sum(ln) AS ln, count(*) FILTER (la IS NOT NULL AND ln IS NOT NULL) AS geo_n
  FROM usable GROUP BY ALL
)"""
)


def _mean(total: str, n: str) -> str:
    """total (hundred-millionths) / n at seven places, as a double."""
    return f"CAST(sign({total}) * ((2 * abs({total}) + 10 * {n}) // (20 * {n})) AS DOUBLE) / 10000000"


STREET = (
    VARIANT
    + f""", winner AS (
  SELECT state, locality, postcode, street_key, street_name, street_type, street_suffix FROM variant
  QUALIFY row_number() OVER (PARTITION BY state, locality, postcode, street_key
    ORDER BY n DESC, CASE WHEN street_type = '' THEN 1 ELSE 0 END, length(street_type) DESC, street_name) = 1
), totals AS (
  SELECT state, locality, postcode, street_key, CAST(sum(n) AS BIGINT) AS address_count, sum(la) AS la, sum(ln) AS ln, nullif(sum(geo_n), 0) AS g
  FROM variant GROUP BY ALL
), street AS (
  SELECT w.*, t.address_count, {_mean('la', 'g')} AS lat, {_mean('ln', 'g')} AS lng
  FROM winner w JOIN totals t USING (state, locality, postcode, street_key)
)"""
)

#: Means at twelve places first, then at seven, as they are stored.
_AVG = "CAST(sign({s}) * ((2 * ((2 * abs({s}) * 10000 + {n}) // (2 * {n})) + 100000) // 200000) AS HUGEINT)"

PLACE = (
    STREET
    + f""", principal AS (
  SELECT lpad(trim(postcode), 4, '0') AS postcode, upper(trim(locality_name)) AS locality, upper(trim(state)) AS state,
    CAST(CAST(nullif(trim(latitude), '') AS DECIMAL(38,8)) * 100000000 AS HUGEINT) AS la,
    CAST(CAST(nullif(trim(longitude), '') AS DECIMAL(38,8)) * 100000000 AS HUGEINT) AS ln
  FROM address_ref
  WHERE regexp_full_match(coalesce(trim(postcode), ''), '[0-9]{{4}}') AND nullif(trim(locality_name), '') IS NOT NULL
    AND nullif(trim(state), '') IS NOT NULL AND coalesce(trim(alias_principal), '') <> 'ALIAS'
), g0 AS (
  SELECT state, locality, postcode, sum(la) AS la, nullif(count(la), 0) AS lan, sum(ln) AS ln, nullif(count(ln), 0) AS lnn, count(*) AS address_count
  FROM principal GROUP BY ALL
), gnaf AS (
  SELECT state, locality, postcode, address_count, {_AVG.format(s='la', n='lan')} AS lat7, {_AVG.format(s='ln', n='lnn')} AS lng7 FROM g0
), centroid0 AS (
  SELECT state, postcode, sum(lat7 * address_count) AS la, sum(lng7 * address_count) AS ln, sum(address_count) AS n FROM gnaf GROUP BY ALL
), centroid AS (
  SELECT state, postcode, CAST(sign(la) * ((2 * abs(la) + n) // (2 * n)) AS DOUBLE) / 10000000 AS lat, CAST(sign(ln) * ((2 * abs(ln) + n) // (2 * n)) AS DOUBLE) / 10000000 AS lng
  FROM centroid0
), postcodes AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN CAST(800 + n_nationkey AS VARCHAR) ELSE CAST(2000 + n_nationkey * 10 + c_custkey % 3 AS VARCHAR) END AS postcode,
    CASE c_custkey % 6 WHEN 0 THEN n_name || ' BC' WHEN 1 THEN lower(n_name) ELSE n_name END AS locality, substr(r_name, 1, 3) AS state,
    CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE -(10 + c_custkey % 30) - 0.5 END AS lat, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 113 + c_custkey % 40 + 0.25 END AS lng,
    c_mktsegment AS delivery_type, 'SA2 ' || c_custkey % 50 AS sa2_name, 'SA3 ' || c_custkey % 20 AS sa3_name,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'SA4 ' || c_custkey % 8 END AS sa4_name, 'LGA ' || c_custkey % 12 AS lga_name, 'R' || (c_custkey % 5 + 1) AS remoteness
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), post AS (
  SELECT upper(trim(state)) AS state, upper(trim(locality)) AS locality, lpad(trim(postcode), 4, '0') AS postcode, CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng,
    delivery_type, sa2_name, sa3_name, sa4_name, lga_name, remoteness
  FROM postcodes
  QUALIFY row_number() OVER (PARTITION BY lpad(trim(postcode), 4, '0'), upper(trim(locality)), upper(trim(state)) ORDER BY id) = 1
), place AS (
  SELECT g.state, g.locality, g.postcode, CAST(g.lat7 AS DOUBLE) / 10000000 AS lat, CAST(g.lng7 AS DOUBLE) / 10000000 AS lng, p.lat AS postcode_lat, p.lng AS postcode_lng,
    'gnaf' AS geo_source, g.address_count, true AS in_gnaf, a.postcode IS NOT NULL AS in_auspost, false AS is_postal_only,
    a.delivery_type, a.sa2_name, a.sa3_name, a.sa4_name, a.lga_name, a.remoteness
  FROM gnaf g LEFT JOIN centroid p ON p.state = g.state AND p.postcode = g.postcode
    LEFT JOIN post a ON a.state = g.state AND a.locality = g.locality AND a.postcode = g.postcode
  UNION ALL
  SELECT a.state, a.locality, a.postcode, a.lat, a.lng, a.lat, a.lng, CASE WHEN a.lat IS NULL THEN 'none' ELSE 'auspost' END, 0, false, true, true,
    a.delivery_type, a.sa2_name, a.sa3_name, a.sa4_name, a.lga_name, a.remoteness
  FROM post a WHERE NOT EXISTS (SELECT 1 FROM gnaf g WHERE g.state = a.state AND g.locality = a.locality AND g.postcode = a.postcode)
)"""
)

ALIAS = (
    PLACE
    + """, bucket AS (
  SELECT substr(r_name, 1, 3) || ' ' || n_name AS value, substr(r_name, 1, 3) AS state FROM nation JOIN region ON n_regionkey = r_regionkey
), alias_a AS (
  SELECT DISTINCT upper(trim(a.locality_name)) AS alias_display, l.state, l.locality, l.postcode, 'gnaf_alias' AS alias_type, 1.0 AS confidence, 1 AS pr
  FROM address_ref a JOIN address_ref p ON p.address_detail_pid = a.principal_pid
    JOIN place l ON l.state = upper(trim(p.state)) AND l.locality = upper(trim(p.locality_name)) AND l.postcode = lpad(trim(p.postcode), 4, '0')
  WHERE coalesce(trim(a.alias_principal), '') = 'ALIAS' AND nullif(trim(a.locality_name), '') IS NOT NULL
    AND upper(trim(a.locality_name)) <> upper(trim(p.locality_name))
), alias_b AS (
  SELECT DISTINCT upper(trim(b.value)) AS alias_display, l.state, l.locality, l.postcode, 'state_bucket' AS alias_type, 0.95 AS confidence, 2 AS pr
  FROM bucket b JOIN place l ON l.state = upper(trim(b.state)) AND l.locality = upper(trim(substring(trim(b.value), length(trim(b.state)) + 2)))
  WHERE upper(trim(b.value)) LIKE upper(trim(b.state)) || ' %' AND length(trim(b.value)) > length(trim(b.state)) + 1
), alias_c AS (
  SELECT DISTINCT a.locality AS alias_display, l.state, l.locality, l.postcode, 'auspost_variant' AS alias_type, 0.80 AS confidence, 3 AS pr
  FROM post a JOIN place l ON l.state = a.state AND l.postcode = a.postcode
  WHERE l.in_gnaf AND l.locality <> a.locality
    AND NOT EXISTS (SELECT 1 FROM gnaf g WHERE g.state = a.state AND g.locality = a.locality AND g.postcode = a.postcode)
), alias AS (
  SELECT * FROM (SELECT * FROM alias_a UNION ALL SELECT * FROM alias_b UNION ALL SELECT * FROM alias_c)
  QUALIFY row_number() OVER (PARTITION BY alias_display, state, locality, postcode ORDER BY pr) = 1
)"""
)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(c: str) -> str:
    """The normal form of a text column."""
    s = f"coalesce({c}, '')"
    for char, several in (("ß", "ss"), ("ẞ", "SS"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"), ("Þ", "Th"), ("þ", "th"), ("Ĳ", "IJ"), ("ĳ", "ij"), ("…", "...")):
        s = f"replace({s}, '{char}', '{several}')"
    s = f"regexp_replace({s}, '[\\x{{0300}}-\\x{{036f}}]', '', 'g')"
    s = f"translate({s}, {_quoted(folding()[0])}, {_quoted(folding()[1])})"
    s = f"replace(upper(regexp_replace({s}, '[^\\x00-\\x7F]+', ' ', 'g')), '&', ' AND ')"
    s = f"regexp_replace({s}, '[^A-Z0-9/\\- ]+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({s}, ' *- *', '-', 'g'), ' +', ' ', 'g'))"


_RULES = "[" + ", ".join([f"{{'t': '{p} ', 'f': true}}" for p in QUALIFIER_PREFIXES] + [f"{{'t': ' {s}', 'f': false}}" for s in QUALIFIER_SUFFIXES]) + "]"
_ROUND = f"""list_reduce({_RULES}, lambda a, r: {{'t': CASE
      WHEN r.f AND starts_with(a.t, r.t) AND length(a.t) > length(r.t) THEN substr(a.t, length(r.t) + 1)
      WHEN NOT r.f AND ends_with(a.t, r.t) AND length(a.t) > length(r.t) THEN substr(a.t, 1, length(a.t) - length(r.t))
      ELSE a.t END, 'f': true}}, {{'t': s, 'f': true}}).t"""
#: Names with qualifiers on either side, from customers and nations.
NAMES = (
    """names AS (
  SELECT c_custkey AS id, concat_ws(' ', ["""
    + ", ".join(_quoted(p) for p in QUALIFIER_PREFIXES)
    + """][1 + c_custkey % 13], [""" + ", ".join(_quoted(p) for p in QUALIFIER_PREFIXES)
    + """][1 + c_custkey // 13 % 12], CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE 'PLACE ' || c_nationkey END, ["""
    + ", ".join(_quoted(s) for s in QUALIFIER_SUFFIXES)
    + """][1 + c_custkey // 7 % 12], [""" + ", ".join(_quoted(s) for s in QUALIFIER_SUFFIXES)
    + """][1 + c_custkey % 17]) AS name
  FROM customer
)"""
)

_VARIANT_OUT = "state, locality, postcode, street_key, street_name, street_type, street_suffix, n, CAST(la AS DOUBLE) / 100000000 AS lat_sum, CAST(ln AS DOUBLE) / 100000000 AS lng_sum, geo_n"
_PLACE_OUT = "state, locality, postcode, lat, lng, postcode_lat, postcode_lng, geo_source, address_count, in_gnaf, in_auspost, is_postal_only, delivery_type, sa2_name, sa3_name, sa4_name, lga_name, remoteness, '1' AS norm_version, '2024-01' AS snapshot_id"
_ALIAS_OUT = "alias_display, state, locality, postcode, alias_type, CAST(confidence AS DOUBLE) AS confidence"
_RAW_KEY = "upper(concat_ws(' ', street_name, nullif(street_type, ''), nullif(street_suffix, '')))"
_FORMS = f"""forms AS (
  SELECT DISTINCT state, locality_name, postcode, {_RAW_KEY} AS street_key, street_name AS a, coalesce(street_type, '') AS b, coalesce(street_suffix, '') AS c
  FROM address_ref WHERE nullif(trim(street_name), '') IS NOT NULL
), collision AS (
  SELECT state, locality_name, postcode, street_key, count(*) AS variants, string_agg('[' || a || '|' || b || '|' || c || ']', ' ' ORDER BY a, b, c) AS forms
  FROM forms GROUP BY state, locality_name, postcode, street_key HAVING count(*) > 1
)"""
_TEXTS = f"""texts AS (
  SELECT o_orderkey AS id, concat_ws(' ', o_orderkey % 400, p_name, n_name, CASE WHEN o_orderkey % 2 = 0 THEN substr(r_name, 1, 3) END) AS text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON p_partkey = o_orderkey % 200
), toks AS (SELECT id, string_split({norm('text')}, ' ') AS t FROM texts),
grams AS (
  SELECT id, CAST(s AS INTEGER) AS "start", CAST(s + k AS INTEGER) AS "end", array_to_string(t[s + 1 : s + k], ' ') AS span
  FROM toks, unnest(range(1, 5)) AS ks(k), unnest(range(0, len(t) - k + 1)) AS ss(s)
  WHERE k <= len(t)
)"""
_HIT = f"""keys AS (
  SELECT {norm('alias_display')} AS key, state, locality, postcode, CAST(confidence AS DOUBLE) AS confidence, 2 AS kind FROM alias
  UNION ALL SELECT {norm('locality')}, state, locality, postcode, 1.0, 1 FROM place
), hit AS (
  SELECT g.id, g."start", g."end", k.* FROM grams g JOIN keys k ON k.key = g.span
)"""

ORACLES: dict[str, str] = {
    "street_variants": f"WITH {VARIANT} SELECT {_VARIANT_OUT} FROM variant",
    "street_canonical": f"WITH {STREET} SELECT * FROM street",
    "street_discarded": f"""WITH {STREET} SELECT {_VARIANT_OUT} FROM variant v
      ANTI JOIN winner w USING (state, locality, postcode, street_key, street_name, street_type, street_suffix)""",
    "street_collisions": f"WITH {ADDRESS}, {_FORMS} SELECT * FROM collision",
    "street_worst_collisions": f"WITH {ADDRESS}, {_FORMS} SELECT * FROM collision ORDER BY variants DESC, state NULLS FIRST, locality_name NULLS FIRST, postcode NULLS FIRST, street_key NULLS FIRST LIMIT 50",
    "street_key_forms": f"WITH {ADDRESS} SELECT street_name, street_type, street_suffix, count(*) AS n FROM address_ref WHERE state = 'AFR' AND locality_name = 'NATION_0' AND postcode = '2000' AND {_RAW_KEY} = 'SMALL RING' GROUP BY 1, 2, 3",
    "street_conservation": f"WITH {STREET} SELECT CAST((SELECT sum(address_count) FROM street) AS BIGINT) AS gazetteer_addresses, (SELECT count(*) FROM usable) AS source_addresses",
    "street_merged_keys": f"WITH {VARIANT} SELECT count(*) AS merged_keys FROM (SELECT 1 FROM variant GROUP BY state, locality, postcode, street_key HAVING count(*) > 1)",
    "street_summary": f"WITH {STREET} SELECT count(*) AS street_rows, count(DISTINCT concat_ws('|', state, locality, postcode)) AS localities, count(*) FILTER (lat IS NULL) AS rows_without_geometry FROM street",
    "street_out_of_bounds": f"WITH {STREET} SELECT count(*) AS out_of_bounds FROM street WHERE state <> 'OT' AND lat IS NOT NULL AND (lat NOT BETWEEN -44 AND -9 OR lng NOT BETWEEN 112 AND 154)",
    "street_spot": f"WITH {STREET} SELECT * FROM street WHERE state = 'AFR' AND locality = 'NATION_0' AND street_key = 'SMALL RING'",
    "blank_coordinates": f"WITH {ADDRESS} SELECT count(*) AS blank_or_null_coords FROM address_ref WHERE nullif(trim(latitude), '') IS NULL OR nullif(trim(longitude), '') IS NULL",
    "locality_from_addresses": f"WITH {PLACE} SELECT state, locality, postcode, CAST(lat7 AS DOUBLE) / 10000000 AS lat, CAST(lng7 AS DOUBLE) / 10000000 AS lng, address_count FROM gnaf",
    "postcode_centroid": f"WITH {PLACE} SELECT * FROM centroid",
    "postal_dedupe": f"WITH {PLACE} SELECT * FROM post",
    "postal_only_anti": f"WITH {PLACE} SELECT post.* FROM post ANTI JOIN gnaf USING (state, locality, postcode)",
    "locality_merge": f"WITH {PLACE} SELECT {_PLACE_OUT} FROM place",
    "locality_full_outer": f"WITH {PLACE} SELECT {_PLACE_OUT} FROM place",
    "locality_street_counts": f"WITH {PLACE} SELECT l.state, l.locality, l.postcode, coalesce(s.n, 0) AS street_count FROM place l LEFT JOIN (SELECT state, locality, postcode, count(*) AS n FROM street GROUP BY ALL) s USING (state, locality, postcode)",
    "street_norm_keys": f"WITH {STREET} SELECT state, locality, postcode, street_key, {norm('street_key')} AS street_norm_key FROM street",
    "locality_norm_keys": f"WITH {PLACE} SELECT state, locality, postcode, {norm('locality')} AS norm_key FROM place",
    "locality_out_of_bounds": f"WITH {PLACE} SELECT count(*) AS out_of_bounds FROM place WHERE state <> 'OT' AND lat IS NOT NULL AND (lat NOT BETWEEN -44 AND -9 OR lng NOT BETWEEN 112 AND 154)",
    "locality_spots": f"WITH {PLACE} SELECT state, locality, postcode, address_count, in_gnaf, in_auspost, is_postal_only FROM place WHERE locality IN ('NATION_1', 'NATION_2 BC', 'NATION_3', 'NATION_9')",
    "provenance_totals": f"WITH {PLACE} SELECT count(*) AS total, count(*) FILTER (in_gnaf) AS from_gnaf, count(*) FILTER (in_auspost) AS from_auspost, count(*) FILTER (is_postal_only) AS postal_only, count(*) FILTER (geo_source = 'none') AS no_geometry FROM place",
    "ambiguous_localities": f"WITH {PLACE} SELECT locality, count(DISTINCT state) AS states, string_agg(DISTINCT state, ',' ORDER BY state) AS state_list FROM place GROUP BY locality HAVING count(DISTINCT state) > 1 ORDER BY states DESC, locality LIMIT 40",
    "alias_principal": f"WITH {ALIAS} SELECT {_ALIAS_OUT} FROM alias_a",
    "alias_state_bucket": f"WITH {ALIAS} SELECT {_ALIAS_OUT} FROM alias_b",
    "alias_postal_variant": f"WITH {ALIAS} SELECT {_ALIAS_OUT} FROM alias_c",
    "alias_all_precedence": f"WITH {ALIAS} SELECT {_ALIAS_OUT}, {norm('alias_display')} AS alias_norm_key, '1' AS norm_version FROM alias",
    "alias_collisions": f"WITH {ALIAS} SELECT alias_display, count(*) AS targets FROM alias GROUP BY 1 HAVING count(*) > 1",
    "alias_worst_collisions": f"WITH {ALIAS} SELECT alias_display, count(*) AS targets FROM alias GROUP BY 1 HAVING count(*) > 1 ORDER BY targets DESC, alias_display LIMIT 40",
    "alias_manual_export": f"WITH {PLACE} SELECT 'THE ' || locality AS alias_display, locality, state, postcode, CAST(1.0 AS DOUBLE) AS confidence FROM place WHERE is_postal_only",
    "normalize_documents": f"SELECT doc_id, {norm('text')} AS norm FROM documents",
    "strip_qualifiers_names": f"""WITH {NAMES}, r0 AS (SELECT id, name, name AS s FROM names), r1 AS (SELECT id, name, {_ROUND} AS s FROM r0), r2 AS (SELECT id, name, {_ROUND} AS s FROM r1),
      r3 AS (SELECT id, name, {_ROUND} AS s FROM r2), r4 AS (SELECT id, name, {_ROUND} AS s FROM r3), r5 AS (SELECT id, name, {_ROUND} AS s FROM r4)
      SELECT id, name, trim(s) AS stripped FROM r5""",
    "token_ngrams": f'WITH {_TEXTS} SELECT id, "start", "end", span FROM grams',
    "cache_keys": f"SELECT doc_id, 'loc:1:' || sha1(concat_ws(chr(31), {norm('text')}, 'AUS', lang)) AS cache_key FROM documents",
    "granularity_at_least": """WITH o AS (SELECT * FROM (VALUES ('unit', 1), ('address', 2), ('street', 3), ('postcode', 4), ('locality', 5), ('admin1', 6), ('city', 7), ('country', 8), ('unresolved', 9)) t(g, k))
      SELECT a.g AS got, b.g AS want, a.k <= b.k AS ok FROM o a CROSS JOIN o b""",
    "key_health": f"""WITH {ALIAS} SELECT 'aliases' AS "table", count(*) AS n, CAST(0 AS BIGINT) AS key_missing FROM alias
      UNION ALL SELECT 'localities', count(*), 0 FROM place UNION ALL SELECT 'streets', count(*), NULL FROM street UNION ALL SELECT 'unresolved', NULL, NULL""",
    "key_backfill": f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {norm('source')} ELSE 'OLD' END AS norm_key, CASE WHEN doc_id % 3 = 0 THEN '1' ELSE '0' END AS norm_version FROM documents",
    "key_verify": """SELECT 'documents' AS "table", count(*) FILTER (doc_id % 3 = 0) AS missing, count(*) FILTER (doc_id % 3 <> 0) AS stale, count(*) = 0 AS ok FROM documents""",
    "address_json": f"""WITH {STREET} SELECT to_json({{'state': state, 'locality': locality, 'postcode': postcode, 'street_key': street_key, 'address_count': address_count}})::VARCHAR AS json FROM street""",
    "resolve_exact": f"""WITH {PLACE}, asked AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'Greater Nation_' || doc_id % 31 ELSE 'nation_' || doc_id % 31 END AS text FROM documents),
      keyed AS (SELECT id, {norm('text')} AS k FROM asked), bare AS (SELECT id, k, CASE WHEN starts_with(k, 'GREATER ') THEN substr(k, 9) ELSE k END AS b FROM keyed),
      names AS (SELECT {norm('locality')} AS key, CAST(sum(address_count) AS BIGINT) AS n FROM place GROUP BY 1)
      SELECT id, coalesce(p.key, q.key) AS key, coalesce(p.n, q.n) AS n FROM bare LEFT JOIN names p ON p.key = k LEFT JOIN names q ON q.key = b""",
    "resolve_longest_span": f"""WITH {ALIAS}, {_TEXTS}, {_HIT} SELECT id, "start", "end", key AS span FROM (SELECT DISTINCT id, "start", "end", key FROM hit)
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY "end" - "start" DESC, "start", key) = 1""",
    "resolve_alias_scored": f"""WITH {ALIAS}, {_TEXTS}, {_HIT} SELECT id, locality, state, postcode, confidence FROM hit
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY "end" - "start" DESC, confidence DESC, kind, state, locality, postcode) = 1""",
    "resolve_fuzzy": f"""WITH names AS (SELECT DISTINCT {norm('p_name')} AS key FROM part),
      asked AS (SELECT p_partkey AS id, {norm("CASE p_partkey % 3 WHEN 0 THEN p_name || 's' WHEN 1 THEN replace(p_name, 'e', 'i') ELSE p_name || 'ing on' END")} AS k FROM part),
      met AS (SELECT id, key, round(100.0 * (1.0 - CAST(levenshtein(k, key) AS DOUBLE) / greatest(length(k), length(key), 1)), 6) AS score
        FROM asked CROSS JOIN names)
      SELECT id, key, score FROM met WHERE score >= 85 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, key) = 1""",
}
