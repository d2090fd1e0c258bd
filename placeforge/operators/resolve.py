"""Batch resolution of location texts against gazetteers.  The rules are this library's own design.

All gazetteers become one lexicon of keys; every run of up to four words of a
text is looked up in it by one equi join.  What a text states (postcode, state,
country, number) then ranks what it may mean.  Nothing raises: a text that
means nothing known is ``unresolved`` with confidence 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeforge.config import Settings, get_settings
from placeforge.functions.text import NORM_VERSION, at_least, cache_key, ngrams, normalize, strip_qualifiers, tokens
from placeforge.schemas import GRANULARITY, RESPONSE
from placeforge.sources.tables import settle

#: Street types and the forms that they are compared in.
STREET_TYPES = {"CRESCENT": "CR", "CRES": "CR", "DRIVE": "DR", "STREET": "ST", "ROAD": "RD", "AVENUE": "AV", "AVE": "AV", "LANE": "LA", "COURT": "CT", "PLACE": "PL", "TERRACE": "TCE", "HIGHWAY": "HWY", "PARADE": "PDE", "BOULEVARD": "BVD"}


def short_type(key: Column) -> Column:
    """The key with its last word in the short form of a street type."""
    last = F.regexp_extract(key, r"([^ ]+)\z", 1)
    table = F.create_map(*[F.lit(x) for pair in STREET_TYPES.items() for x in pair])
    return F.when(table[last].isNotNull(), F.concat(F.regexp_replace(key, r"[^ ]+\z", ""), table[last])).otherwise(key)


@dataclass
class Gazetteers:
    """localities (locality_id, locality, state, postcode, lat, lng, address_count, is_postal_only), aliases
    (alias_display, locality_id, confidence), streets (state, locality, postcode, street_key, street_name,
    street_type, street_suffix, lat, lng), cities (name, admin1, country, population, lat, lng),
    countries (name, alpha2, alpha3), states (name, code), all of them of moderate size beside the texts.
    """

    localities: DataFrame
    aliases: DataFrame
    streets: DataFrame
    cities: DataFrame
    countries: DataFrame
    states: DataFrame
    country: str = "AUS"


_LEXICON = ["key", "kind", "country", "admin1", "locality", "postcode", "street", "weight", "confidence", "lat", "lng", "postal_only"]


def _entry(df: DataFrame, kind: str, key: Column, **given: Column) -> DataFrame:
    kinds = {"weight": "double", "confidence": "double", "lat": "double", "lng": "double", "postal_only": "boolean", "street": "struct<name:string,type:string,suffix:string>"}
    cols = {c: given.get(c, F.lit(None)).cast(kinds.get(c, "string")) for c in _LEXICON[2:]}
    return df.select(key.alias("key"), F.lit(kind).alias("kind"), *[v.alias(k) for k, v in cols.items()])


def lexicon(g: Gazetteers) -> DataFrame:
    """All keys of all gazetteers."""
    c, here, one = F.col, F.lit(g.country), F.lit(1.0)
    place = {"country": here, "admin1": c("state"), "locality": c("locality"), "postcode": c("postcode"), "weight": c("address_count"), "lat": c("lat"), "lng": c("lng"), "postal_only": c("is_postal_only")}
    named = g.aliases.select("alias_display", "locality_id", c("confidence").alias("alias_confidence")).join(g.localities, "locality_id")
    parts = [
        _entry(g.localities, "locality", normalize("locality"), confidence=one, **place),
        _entry(named, "alias", normalize("alias_display"), confidence=c("alias_confidence"), **place),
        _entry(g.localities.groupBy("state", "postcode").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.sum("address_count").alias("address_count"), F.min("is_postal_only").alias("is_postal_only")),
               "postcode", c("postcode"), confidence=one, **{k: v for k, v in place.items() if k != "locality"}),
        _entry(g.streets, "street", short_type(normalize("street_key")), country=here, admin1=c("state"), locality=c("locality"), postcode=c("postcode"), confidence=one, lat=c("lat"), lng=c("lng"),
               street=F.struct(c("street_name").alias("name"), c("street_type").alias("type"), c("street_suffix").alias("suffix"))),
        _entry(g.cities, "city", normalize("name"), country=c("country"), admin1=c("admin1"), locality=c("name"), weight=c("population"), confidence=one, lat=c("lat"), lng=c("lng")),
        _entry(g.countries, "country", normalize("name"), country=c("alpha3"), confidence=one),
        _entry(g.countries, "country", normalize("alpha3"), country=c("alpha3"), confidence=one),
        _entry(g.states, "state", normalize("name"), country=here, admin1=c("code"), confidence=one),
        _entry(g.states, "state", normalize("code"), country=here, admin1=c("code"), confidence=one),
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.where("key <> ''").distinct()


def spans(queries: DataFrame, max_len: int = 4) -> DataFrame:
    """id, start, end, span of all runs of words of ``norm``, and the whole text without qualifiers."""
    own = queries.select("id", F.explode(ngrams("toks", max_len)).alias("g")).select("id", "g.start", "g.end", "g.span")
    bare = queries.where("stripped <> norm AND stripped <> ''").select("id", F.lit(0).alias("start"), F.size("toks").alias("end"), F.col("stripped").alias("span"))
    return own.unionByName(bare)


def longest_spans(queries: DataFrame, names: DataFrame, key: str = "key") -> DataFrame:
    """The longest run of each text that is a key of ``names``; ties to the left, then to the smaller key."""
    hits = spans(queries).join(names.select(F.col(key).alias("span")).distinct(), "span")
    order = Window.partitionBy("id").orderBy((F.col("end") - F.col("start")).desc(), "start", "span")
    return hits.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("id", "start", "end", "span")


def similarity(a: Column, b: Column) -> Column:
    """0 to 100: 100 for equal texts, less by the share of edits."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.round(100.0 * (F.lit(1.0) - F.levenshtein(a, b) / longest), 6)


def most_edits(longest: Column, least: float) -> Column:
    """The most edits with which two texts, the longer one of ``longest`` letters, still have the least similarity."""
    return F.floor(longest * F.lit(1.0 - least / 100.0) + 1e-6).cast("int")


def fuzzy(texts: DataFrame, names: DataFrame, least: float, by: tuple[str, ...] = ()) -> DataFrame:
    """id, key, score (and ``by``) of the most similar name at ``least`` (50 or more) or above; ties to the smaller name.

    texts: id, norm; names: key; both with the columns ``by``, which must be
    equal.  No pair is lost: a name is cut into one segment more than the edits
    that any text similar to it may differ by, so one segment stands unchanged
    in the text, shifted by no more than the edits on either side of it allow.
    Texts that are equal meet the names once.
    """
    if least < 50:
        raise ValueError("the least similarity must be 50 or more")
    share = least / 100.0
    # of a name of m letters: the edits that the longest similar text allows, and the segment i
    edits = most_edits(F.floor(F.col("m") / share + 1e-6), least)
    size, extra = F.floor(F.col("m") / (F.col("d") + 1)).cast("int"), F.col("m") % (F.col("d") + 1)
    longer = F.col("i") - (F.col("d") + 1 - extra)  # the last segments are one letter longer
    segment = {"p": (F.col("i") * size + F.greatest(longer, F.lit(0))).cast("int"), "l": size + (longer >= 0).cast("int")}
    known = names.select(*by, "key").where("key <> ''").distinct().withColumn("m", F.length("key")).withColumn("d", edits)
    known = known.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d")))).withColumns(segment)
    known = known.select(*by, "key", "m", "i", F.substr(F.col("key"), F.col("p") + 1, F.col("l")).alias("segment"))
    distinct = texts.select(*by, "norm").where("norm <> ''").distinct().withColumn("n", F.length("norm"))
    asked = distinct.withColumn("m", F.explode(F.sequence(F.ceil(F.col("n") * share - 1e-6).cast("int"), F.floor(F.col("n") / share + 1e-6).cast("int"))))
    asked = asked.withColumn("d", edits).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d")))).withColumns(segment)
    shift, after = F.col("n") - F.col("m"), F.col("d") - F.col("i")
    low = F.greatest(F.lit(0), F.col("p") - F.col("i"), F.col("p") + shift - after)
    high = F.least(F.col("n") - F.col("l"), F.col("p") + F.col("i"), F.col("p") + shift + after)
    asked = asked.withColumns({"low": low, "high": high}).where("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    asked = asked.select(*by, "norm", "m", "i", F.substr(F.col("norm"), F.col("at") + 1, F.col("l")).alias("segment")).distinct()
    score = similarity(F.col("norm"), F.col("key"))
    met = asked.join(known, [*by, "m", "i", "segment"]).withColumn("score", score).where(F.col("score") >= least)
    best = met.groupBy(*by, "norm").agg(F.min(F.struct((-F.col("score")).alias("worse"), "key")).alias("best"))
    found = best.select(*by, "norm", F.col("best.key").alias("key"), (-F.col("best.worse")).alias("score"))
    return texts.select("id", *by, "norm").join(found, [*by, "norm"]).select("id", *by, "key", "score")


def prepare(texts: DataFrame) -> DataFrame:
    """Adds norm, stripped, toks and the parsed numbers to (id, text)."""
    rows = texts.select("id", F.col("text").alias("query"), normalize("text").alias("norm"))
    rows = rows.withColumns({"toks": tokens("norm"), "stripped": strip_qualifiers("norm")})
    part = lambda pattern, k: F.nullif(F.regexp_extract("norm", pattern, k), F.lit(""))
    slash, spelled = r"\A([0-9A-Z]+)/([0-9]+) ", r"\A(?:UNIT|FLAT|APT|SUITE) ([0-9A-Z]+) ([0-9]+) "
    return rows.withColumns({
        "flat": F.coalesce(part(slash, 1), part(spelled, 1)),
        "number_first": F.coalesce(part(slash, 2), part(spelled, 2), part(r"\A([0-9]+)(?:-[0-9]+)? [A-Z]", 1)),
        "number_last": part(r"\A[0-9]+-([0-9]+) [A-Z]", 1),
        "box": F.col("norm").rlike(r"\A(?:GPO|PO|P O) BOX "),
    })


def resolve(texts: DataFrame, g: Gazetteers, country_bias: str | None = None, min_granularity: str | None = None, settings: Settings | None = None) -> DataFrame:
    """id and the response of each of ``texts`` (id, text).

    With ``min_granularity`` what is less specific stays unresolved.
    ``resolve_once`` sends texts of equal meaning once.
    """
    s = settings or get_settings()
    bias = F.lit(country_bias or s.country_bias)
    asked = prepare(texts)
    # both are used in many branches below, whose plans would else repeat them
    words = settle(lexicon(g))
    found = spans(asked)
    keyed = found.withColumn("key", F.col("span")).unionByName(found.withColumn("key", short_type(F.col("span")))).distinct()
    # places first: a street is looked up in the places that a text names, not in all that have it
    hits = keyed.join(words.where("kind <> 'street'"), "key")
    length = F.col("end") - F.col("start")
    stated = hits.groupBy("id").agg(
        F.collect_set(F.when(F.col("kind") == "postcode", F.col("postcode"))).alias("postcodes"),
        F.collect_set(F.when(F.col("kind") == "state", F.col("admin1"))).alias("states"),
        F.collect_set(F.when(F.col("kind") == "country", F.col("country"))).alias("countries"),
        F.coalesce(F.max(F.when(F.col("kind") == "country", length)), F.lit(0)).alias("country_words"),
        F.coalesce(F.max(F.when(F.col("kind") == "state", length)), F.lit(0)).alias("state_words"),
    )
    rows = hits.join(stated, "id").join(asked.select("id", "toks", "flat", "number_first", "number_last", "box"), "id").withColumn("size", F.size("toks"))
    rows = settle(rows)
    agrees = lambda c, given: F.when(F.size(given) == 0, 0.0).when(F.array_contains(given, F.col(c)), 1.0).otherwise(-2.0)
    fit = agrees("postcode", "postcodes") + agrees("admin1", "states") + agrees("country", "countries")
    tie = F.log1p(F.coalesce("weight", F.lit(0.0))) / 100.0
    places = rows.where(F.col("kind").isin("locality", "alias")).withColumn("score", length * 1.0 + fit + F.col("confidence") + tie)
    # a street counts where its locality is named as well, by other words
    near = places.select("id", F.col("admin1").alias("a1"), F.col("locality").alias("place"), F.col("postcode").alias("pc"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("score").alias("place_score"))
    lines = words.where("kind = 'street'").select("key", F.col("admin1").alias("a1"), F.col("locality").alias("place"), F.col("postcode").alias("pc"), "country", "street", "confidence", "lat", "lng", "weight")
    parsed = asked.select("id", "toks", "flat", "number_first", "number_last")
    there = settle(near.distinct())
    own_streets = keyed.join(there, "id").where("end <= s OR e <= start").join(lines, ["key", "a1", "place", "pc"])
    # what stands before the place, without numbers and without the stated postcode and state
    told = there.join(parsed, "id").join(stated.select("id", "postcodes", "states"), "id")
    rest = F.filter(F.slice("toks", F.lit(1), F.col("s")), lambda x: ~F.array_contains("postcodes", x) & ~F.array_contains("states", x))
    rest = F.regexp_replace(F.array_join(rest, " "), r"\A(?:(?:UNIT|FLAT|APT|SUITE) [0-9A-Z]+ )?(?:[0-9A-Z]*[0-9][0-9A-Z/-]* )?", "")
    left_over = told.withColumn("norm", short_type(rest)).where("norm RLIKE '[A-Z]'").join(own_streets.select("id").distinct(), "id", "left_anti")
    alike = fuzzy(left_over.select("id", "a1", "place", "pc", "norm").distinct(), lines, s.fuzzy_street_min, ("a1", "place", "pc"))
    similar = alike.withColumnRenamed("score", "alike").join(lines.drop("confidence"), ["key", "a1", "place", "pc"]).join(there.groupBy("id", "a1", "place", "pc").agg(F.max("place_score").alias("place_score")), ["id", "a1", "place", "pc"])
    named = {"admin1": F.col("a1"), "locality": F.col("place"), "postcode": F.col("pc")}
    streets = own_streets.withColumns(named).join(parsed, "id")
    similar = similar.withColumns(named | {"confidence": F.col("alike") / 100.0, "start": F.lit(0), "end": F.lit(0)}).join(parsed, "id")
    whole = F.col("size") - F.col("country_words") - F.col("state_words")
    numbered = F.col("number_first").isNotNull()

    def option(df: DataFrame, rank: int, granularity: Column, method: Column, score: Column, source: str) -> DataFrame:
        return df.select(
            "id", F.lit(rank).alias("rank"), score.cast("double").alias("score"), granularity.alias("granularity"), method.alias("match_method"), F.col("confidence").alias("trust"),
            "country", "admin1", "locality", "postcode", "lat", "lng", F.lit(source).alias("source"), "street", "flat", "number_first", "number_last", "weight",
        )

    lit = F.lit
    street_kind = F.when(numbered & F.col("flat").isNotNull(), "unit").when(numbered, "address").otherwise("street")
    settled = (F.size("postcodes") > 0) | (F.size("states") > 0)
    city = rows.where(F.col("kind") == "city").where((length == whole) | (length == F.col("size") - F.col("country_words")) | (length == F.col("size")))
    city = city.withColumn("fit", agrees("country", "countries")).where("fit >= 0")
    ordinary = places.where(F.coalesce("postal_only", lit(False)) == False).where(fit > -1.5)  # noqa: E712
    mailed = places.where("postal_only").where(fit > -1.5)
    alone = rows.withColumn("nothing", lit(0.0))
    options = [
        option(streets, 1, street_kind, lit("gnaf_street_centroid"), length * 1.0 + F.col("place_score"), "gnaf_street_centroid"),
        option(similar, 1, street_kind, lit("gnaf_street_centroid"), F.col("alike") / 100.0 + F.col("place_score"), "gnaf_street_centroid"),
        option(mailed, 2, lit("postcode"), lit("postal_only"), F.col("score") + F.when(F.col("box"), 1.0).otherwise(0.0), "postcode_centroid"),
        option(ordinary.where(settled), 3, lit("locality"), F.when(F.col("kind") == "alias", "locality_alias").otherwise("locality_exact"), F.col("score"), "locality_centroid"),
        option(city, 4, lit("city"), lit("city_exact"), F.log1p(F.coalesce("weight", lit(0.0))) + F.when(F.col("country") == bias, s.country_bias_weight).otherwise(0.0), "city_point"),
        option(ordinary.where(~settled), 5, lit("locality"), F.when(F.col("kind") == "alias", "locality_alias").otherwise("locality_exact"), F.col("score"), "locality_centroid"),
        option(alone.where("kind = 'postcode'"), 6, lit("postcode"), lit("state_bucket"), tie, "postcode_centroid"),
        option(alone.where("kind = 'state'").where(whole == 0), 7, lit("admin1"), lit("state_bucket"), length, "none"),
        option(alone.where("kind = 'country'").where(length == F.col("size")), 8, lit("country"), lit("country_bucket"), length, "none"),
    ]
    every = options[0]
    for more in options[1:]:
        every = every.unionByName(more)
    every = settle(every)
    # texts without an exact meaning: similar names
    left = asked.join(every.select("id").distinct(), "id", "left_anti")
    for rank, kind, method, least in ((9, "city", "city_fuzzy", s.fuzzy_city_min), (10, "locality", "locality_fuzzy", s.fuzzy_locality_min)):
        names = words.where(F.col("kind") == kind)
        near_names = fuzzy(left, names, least).join(names, "key").join(left.select("id", "flat", "number_first", "number_last"), "id")
        near_names = near_names.withColumn("confidence", F.col("score") / 100.0)
        every = every.unionByName(option(near_names, rank, lit(kind), lit(method), F.col("score") + tie, "city_point" if kind == "city" else "locality_centroid"))
    if min_granularity:
        every = every.where(at_least(F.col("granularity"), lit(min_granularity), GRANULARITY))
    order = Window.partitionBy("id").orderBy("rank", F.desc("score"), F.desc_nulls_last("weight"), "country", "admin1", "locality", "postcode")
    # a place's row may come by several keys
    same = every.groupBy("id", "rank", "granularity", "match_method", "country", "admin1", "locality", "postcode", "source", "street", "flat", "number_first", "number_last").agg(
        F.max("score").alias("score"), F.max("trust").alias("trust"), F.max("weight").alias("weight"), F.max("lat").alias("lat"), F.max("lng").alias("lng")
    )
    placed = same.withColumn("rn", F.row_number().over(order))
    best = placed.where("rn = 1")
    peers = placed.join(best.select("id", F.col("rank").alias("best_rank")), "id").where("rank = best_rank AND rn BETWEEN 2 AND 6")
    label = F.concat_ws(", ", "locality", "admin1", "country")
    others = peers.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rn", label.alias("label"), F.round("trust", 4).alias("confidence"), "granularity", "country", "admin1", "locality", lit("same rank").alias("reason"), "weight"))).alias("others"))
    joined = asked.select("id", "query", "norm").join(best, "id", "left").join(others, "id", "left")
    rivals = F.coalesce(F.aggregate("others", lit(0.0), lambda a, o: a + F.coalesce(o["weight"], lit(0.0))), lit(0.0))
    clear = F.when((F.col("granularity") == "city") & (rivals > 0), F.col("weight") / (F.col("weight") + rivals)).otherwise(lit(1.0))
    got = F.col("granularity").isNotNull()
    tied = (F.col("match_method") == "city_exact") & (F.size(F.coalesce("others", F.array())) > 0)
    country_name = g.countries.select(F.col("name").alias("c_name"), F.col("alpha2").alias("c_alpha2"), F.col("alpha3").alias("country"))
    state_name = g.states.select(F.col("name").alias("s_name"), F.col("code").alias("admin1"))
    joined = joined.join(country_name, "country", "left").join(state_name, "admin1", "left")
    st = F.col("street")
    formatted = F.concat_ws(" ", F.concat_ws("/", "flat", F.concat_ws("-", "number_first", "number_last")), st["name"], F.nullif(st["type"], lit("")), F.nullif(st["suffix"], lit("")), "locality", "admin1", "postcode")
    none = lit(None).cast("string")
    values = {
        "query": F.col("query"), "normalized": F.col("norm"), "resolved": got, "granularity": F.coalesce("granularity", lit("unresolved")),
        "confidence": F.round(F.coalesce(F.col("trust") * clear, lit(0.0)), 4), "match_method": F.when(tied, "city_population_tiebreak").otherwise(F.coalesce("match_method", lit("none"))),
        "country": F.when(F.col("country").isNotNull(), F.struct(F.col("c_name"), F.col("c_alpha2"), F.col("country"))),
        "admin1": F.when(F.col("admin1").isNotNull(), F.struct(F.coalesce("s_name", "admin1"), F.when(F.col("s_name").isNotNull(), F.col("admin1")))),
        "locality": F.when(F.col("granularity") != "city", F.col("locality")), "postcode": F.col("postcode"),
        "geo": F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct("lat", "lng", "source")),
        "au_address": F.when(st.isNotNull(), F.struct(none, F.when(F.col("flat").isNotNull(), "UNIT"), F.col("flat"), none, none, F.col("number_first"), F.col("number_last"), st["name"], st["type"], st["suffix"], F.col("locality"), F.col("admin1"), F.col("postcode"), none, none, none, formatted)),
        "candidates": F.transform(F.coalesce("others", F.array()), lambda o: F.struct(o["label"], o["confidence"], o["granularity"], o["country"], o["admin1"], o["locality"], o["reason"])),
        "warnings": F.when(tied & (clear < 0.6), F.array(lit("ambiguous"))).otherwise(F.array().cast("array<string>")), "norm_version": lit(NORM_VERSION), "snapshot_id": none,
    }
    return joined.select("id", *[values[f.name].cast(f.dataType).alias(f.name) for f in RESPONSE.fields])


def resolve_once(texts: DataFrame, g: Gazetteers, country_bias: str | None = None, min_granularity: str | None = None, settings: Settings | None = None) -> DataFrame:
    """As ``resolve``, but texts with one cache key are resolved once; each keeps its own id and query."""
    s = settings or get_settings()
    keyed = texts.select("id", "text", cache_key("loc", "text", F.lit(country_bias or s.country_bias), F.lit(min_granularity or "")).alias("cache_key"))
    distinct = keyed.groupBy("cache_key").agg(F.min("text").alias("text")).select(F.col("cache_key").alias("id"), "text")
    found = resolve(distinct, g, country_bias, min_granularity, s).withColumnRenamed("id", "cache_key").drop("query")
    return keyed.join(found, "cache_key").select("id", F.col("text").alias("query"), *[f.name for f in RESPONSE.fields if f.name != "query"])


def resolve_batch(spark: SparkSession, items: list[str | None], g: Gazetteers, settings: Settings | None = None, **options: str) -> list[dict]:
    """The responses of a request of at most ``batch_limit`` texts, in their order."""
    s = settings or get_settings()
    if len(items) > s.batch_limit:
        raise ValueError(f"more than {s.batch_limit} texts")
    texts = spark.createDataFrame(list(enumerate(items)), "id long, text string")
    found = {r["id"]: r.asDict(recursive=True) for r in resolve_once(texts, g, settings=s, **options).collect()}  # bounded by the limit
    return [found[i] for i in range(len(items))]


def judged(golden: DataFrame, responses: DataFrame) -> DataFrame:
    """Golden cases (id, input, expected_...) with what was found and ``ok``: all expectations that are given hold."""
    r = responses.select("id", "granularity", F.col("country.alpha3").alias("country"), F.coalesce("admin1.code", "admin1.name").alias("admin1"), "locality")
    ok = lambda want, got: (F.col(want) == "") | F.coalesce(F.col(want) == F.col(got), F.lit(False))
    return golden.join(r, "id", "left").withColumn("ok", ok("expected_granularity", "granularity") & ok("expected_country", "country") & ok("expected_admin1", "admin1") & ok("expected_locality", "locality"))


def accuracy(cases: DataFrame) -> DataFrame:
    """cases, passed, accuracy in per cent of ``judged`` cases."""
    return cases.agg(F.count(F.lit(1)).alias("cases"), F.count_if("ok").alias("passed"), (100.0 * F.count_if("ok") / F.count(F.lit(1))).alias("accuracy"))


def failures(cases: DataFrame, limit: int = 30) -> DataFrame:
    """The first failed cases by id."""
    return cases.where("NOT ok").orderBy("id").limit(limit)
