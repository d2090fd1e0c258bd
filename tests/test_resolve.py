"""The resolver on a small world; its rules are this library's own."""

import random

import pytest

from placeforge import cli
from placeforge.config import Settings
from placeforge.operators import resolve as R
from placeforge.plans.build import from_folder, from_test_tables, publish_all
from placeforge.sources import tables
from placeforge.streaming import resolve as stream

#: name, state, postcode, addresses, postal only
PLACES = [
    ("ASHBROOK", "QLD", "4801", 700, False), ("DUNMORE", "NT", "0871", 40, False), ("DUNMORE", "QLD", "4990", 900, False), ("TWIN-OAKS", "NT", "0872", 120, False),
    ("MAIL CENTRE", "QLD", "4802", 0, True), ("PORT LUNA", "QLD", "4999", 5000, False),
]
#: state, locality, postcode, name, type
STREETS = [("QLD", "ASHBROOK", "4801", "TALLOW", "RD"), ("QLD", "ASHBROOK", "4801", "OLD QUARRY", "CR"), ("NT", "DUNMORE", "0871", "TALLOW", "RD"), ("QLD", "PORT LUNA", "4999", "LIGHTHOUSE", "PDE")]
_LOCALITY = "locality_id long, locality string, state string, postcode string, lat double, lng double, address_count long, is_postal_only boolean, norm_key string, norm_version string"
_STREET = "state string, locality string, postcode string, street_key string, street_name string, street_type string, street_suffix string, lat double, lng double"
WORLD = {
    "localities": (_LOCALITY, [(k, n, s, p, None if mail else -20.0 - k, None if mail else 140.0 + k, c, mail, n, "1") for k, (n, s, p, c, mail) in enumerate(PLACES, 1)]),
    "aliases": ("alias_display string, locality_id long, confidence decimal(3,2), alias_norm_key string", [("THE BROOK", 1, None, "THE BROOK")]),
    "streets": (_STREET, [(s, place, p, f"{n} {t}", n, t, "", -20.5, 140.5) for s, place, p, n, t in STREETS]),
    "cities": ("name string, admin1 string, country string, population long, lat double, lng double", [
        ("Port Luna", "QLD", "AUS", 60000, -20.0, 146.0), ("Port Luna", "Maine", "USA", 2000, 44.0, -69.0), ("Merrow", "Ohio", "USA", 70000, 40.0, -82.0), ("Merrow", "Utah", "USA", 90000, 40.5, -111.0), ("Käsdorf", "Bern", "CHE", 30000, 46.9, 7.4),
    ]),
    "countries": ("name string, alpha2 string, alpha3 string", [("Australia", "AU", "AUS"), ("United States", "US", "USA"), ("Switzerland", "CH", "CHE")]),
    "states": ("name string, code string", [("Queensland", "QLD"), ("Northern Territory", "NT")]),
}


def written_forms():
    """(text, granularity, country, state, locality) by the rules of the resolver, for every place and street of the world."""
    for name, state, code, _, mail in PLACES:
        if mail:
            yield f"GPO Box 9 {name.title()} {state} {code}", "postcode", "AUS", state, ""
        else:
            yield f"{name.lower()} {state}", "locality", "AUS", state, name
            yield f"{state} {code}, {name}", "locality", "AUS", state, name
            yield code, "postcode", "AUS", state, ""
    for state, place, code, name, kind in STREETS:
        spelled = {"RD": "Road", "CR": "Crescent", "PDE": "Parade"}[kind]
        there = f"{place.title()} {state} {code}"
        for number, granularity in (("8 ", "address"), ("8-10 ", "address"), ("3/8 ", "unit"), ("Apt 3 8 ", "unit"), ("", "street")):
            yield f"{number}{name.title()} {spelled}, {there}", granularity, "AUS", state, place
            yield f"{number}{name} {kind} {code} {place}", granularity, "AUS", state, place
        yield f"8 {name[:-1]} {kind} {there}", "address", "AUS", state, place  # a letter is missing: similar streets of the place
    for label, code in WORLD["states"][1]:
        yield label, "admin1", "AUS", code, ""
        yield f"{code} Australia", "admin1", "AUS", code, ""
    for label, _, code in WORLD["countries"][1]:
        yield label, "country", code, "", ""
    yield "metro Port Luna", "city", "AUS", "QLD", ""  # the more people, and the country preferred
    yield "port luna united states", "city", "USA", "Maine", ""
    yield "Merrow", "city", "USA", "Utah", ""
    yield "KASDORF", "city", "CHE", "Bern", ""
    yield "the brook", "locality", "AUS", "QLD", "ASHBROOK"
    yield "Ashbrok", "locality", "AUS", "QLD", "ASHBROOK"  # similar names: letters anywhere, the first ones as well
    yield "Sshbrook", "locality", "AUS", "QLD", "ASHBROOK"
    yield "Dunmore", "locality", "AUS", "QLD", "DUNMORE"  # the one with more addresses
    for nothing in ("", "  ", "&&", "zzzz zzzz", "12345678901234567890"):
        yield nothing, "unresolved", "", "", ""


GOLDEN = list(written_forms())


@pytest.fixture(scope="module")
def world(spark):
    from decimal import Decimal

    rows = {k: (ddl, [tuple(Decimal("0.90") if c is None and k == "aliases" else c for c in r) for r in data]) for k, (ddl, data) in WORLD.items()}
    return {k: spark.createDataFrame(data, ddl) for k, (ddl, data) in rows.items()}


@pytest.fixture(scope="module")
def responses(spark, world):
    texts = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)] + [(1000, None)], "id long, text string")
    settings = Settings(fuzzy_locality_min=85)
    return {r.id: r for r in R.resolve(texts, R.Gazetteers(**world), settings=settings).collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)), ids=[g[0] or "empty" for g in GOLDEN])
def test_written_forms(responses, i):
    text, granularity, country, state, place = GOLDEN[i]
    r = responses[i]
    assert r.granularity == granularity
    assert (r.country.alpha3 if r.country else "") == country
    assert not state or state in (r.admin1.code, r.admin1.name)
    assert not place or r.locality == place
    assert r.query == text and r.resolved == (granularity != "unresolved") and 0 <= r.confidence <= 1


def test_responses_in_detail(responses):
    at = {g[0]: responses[i] for i, g in enumerate(GOLDEN)}
    assert at["Merrow"].confidence < 0.7 and len(at["Merrow"].candidates) == 1 and at["Merrow"].match_method == "city_population_tiebreak"
    unit = at["3/8 Tallow Road, Ashbrook QLD 4801"].au_address
    assert (unit.flat_number, unit.number_first, unit.street_name, unit.formatted) == ("3", "8", "TALLOW", "3/8 TALLOW RD ASHBROOK QLD 4801")
    assert at["8-10 Lighthouse Parade, Port Luna QLD 4999"].au_address.number_last == "10"
    assert at["the brook"].match_method == "locality_alias" and at["the brook"].confidence == 0.9
    assert at["GPO Box 9 Mail Centre QLD 4802"].match_method == "postal_only"
    assert at["Ashbrok"].match_method == "locality_fuzzy" and 0.8 < at["Ashbrok"].confidence < 0.9
    similar = at["8 TALLO RD Ashbrook QLD 4801"]
    assert similar.au_address.street_name == "TALLOW" and 0.85 <= similar.confidence < 1
    assert responses[1000].granularity == "unresolved" and responses[1000].confidence == 0 and responses[1000].match_method == "none"


def test_min_granularity(spark, world):
    texts = spark.createDataFrame([(1, "Port Luna"), (2, "Ashbrook QLD 4801")], "id long, text string")
    got = {r.id: r.granularity for r in R.resolve(texts, R.Gazetteers(**world), min_granularity="locality").collect()}
    assert got == {1: "locality", 2: "locality"}  # a city is not specific enough


def test_equal_texts_are_resolved_once(spark, world):
    items = ["ashbrook, QLD", "Ashbrook  qld", "the brook", None]
    got = R.resolve_batch(spark, items, R.Gazetteers(**world), settings=Settings(batch_limit=4))
    assert [r["query"] for r in got] == items and [r["locality"] for r in got] == ["ASHBROOK"] * 3 + [None]
    with pytest.raises(ValueError, match="more than 3"):
        R.resolve_batch(spark, items, R.Gazetteers(**world), settings=Settings(batch_limit=3))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [60, 85, 88, 100])
def test_fuzzy_finds_what_all_pairs_find(spark, least):
    rng = random.Random(least)
    names = ["".join(rng.choice("AB C") for _ in range(rng.randint(1, 30))).strip() or "A" for _ in range(60)]
    texts = []
    for _ in range(150):
        t = list(rng.choice(names))
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(t))
            t[k : k + rng.randint(0, 1)] = rng.choice(["", "A", "C", "ZZ"])
        texts.append("".join(t))
    wanted = {}
    for k, t in enumerate(texts):
        scored = [(-round(100.0 * (1 - edits(t, n) / max(len(t), len(n), 1)), 6), n) for n in names if t]
        best = min(scored, default=(0, ""))
        if t and -best[0] >= least:
            wanted[k] = (best[1], -best[0])
    got = R.fuzzy(spark.createDataFrame(list(enumerate(texts)), "id long, norm string"), spark.createDataFrame([(n,) for n in names], "key string"), least).collect()
    assert {r.id: (r.key, round(r.score, 6)) for r in got} == wanted and len(got) == len(wanted)


def test_golden_file_and_accuracy(spark, world, tmp_path):
    path = tmp_path / "golden.csv"
    path.write_text("input,expected_granularity,expected_country,expected_admin1,expected_locality,note\nDunmore NT 0871,locality,AUS,NT,DUNMORE,x\n,unresolved,,,,empty\nQLD,country,AUS,,,wrong\n")
    golden = tables.read_golden(spark, str(path)).selectExpr("CASE input WHEN '' THEN 2 WHEN 'QLD' THEN 3 ELSE 1 END AS id", "*")
    assert golden.where("input = ''").count() == 1
    got = R.resolve(golden.selectExpr("id", "input AS text"), R.Gazetteers(**world))
    cases = R.judged(golden, got)
    row = R.accuracy(cases).first()
    assert (row.cases, row.passed) == (3, 2)
    assert [r.input for r in R.failures(cases).collect()] == ["QLD"]


def test_build_publishes_in_order(spark, tmp_path):
    source, target = f"{tmp_path}/source", f"{tmp_path}/out"
    b = from_test_tables(spark, "/root/testdata/sf0.001")
    for name, df in (("address_ref", b.addresses), ("postcodes", b.postcodes), ("state_bucket", b.bucket)):
        df.write.parquet(f"{source}/{name}.parquet")
    assert publish_all(from_folder(spark, source, "2024-01"), target) == ["streets", "localities", "aliases"]
    streets = tables.read_published(spark, f"{target}/streets.parquet")
    assert streets.count() == b.streets.count() and streets.where("street_norm_key IS NULL").count() == 0
    assert tables.read_published(spark, f"{target}/localities.parquet").agg({"street_count": "sum"}).first()[0] == streets.count()
    assert cli.check(spark, target)[1] == []


def test_readers_find_the_old_version_or_the_new_one(spark, tmp_path):
    path, seen = f"{tmp_path}/t.parquet", []
    for k in range(4):
        before = tables.read_published(spark, path)
        tables.publish(spark.range(k + 1), path)
        seen.append((None if before is None else before.count(), tables.read_published(spark, path).count()))  # a reader that has begun goes on
    assert seen == [(None, 1), (1, 2), (2, 3), (3, 4)]
    assert sum(p.name.startswith("v-") for p in (tmp_path / "t.parquet").iterdir()) == 2


def test_sources_and_sinks(spark, world, tmp_path):
    folder = str(tmp_path)
    problems = cli.check(spark, folder)[1]
    assert problems == [f"no table in {folder}"]
    for _ in range(2):
        tables.publish(world["localities"], f"{folder}/localities.parquet", ["state"])
    assert tables.read_published(spark, f"{folder}/localities.parquet").count() == 6 and tables.ping(spark)["answers"] == "true"
    report, problems = cli.check(spark, folder)
    assert {r["table"]: r["n"] for r in report}["localities"] == 6 and "aliases is not there" in problems
    tables.drop(spark, f"{folder}/localities.parquet")
    assert cli.check(spark, folder)[1] == [f"no table in {folder}"]
    tables.write_ndjson(world["states"], f"{folder}/states.json")
    assert spark.read.json(f"{folder}/states.json").count() == 2
    world["states"].createOrReplaceTempView("states")
    assert tables.fetch_all(spark, "SELECT name FROM states WHERE code = :c", c="NT") == [{"name": "Northern Territory"}]
    assert tables.fetch_one(spark, "SELECT * FROM states WHERE code = :c", c="XX") is None
    assert tables.scalar(spark, "SELECT count(*) FROM states") == 2
    assert tables.as_json(world["states"].where("code = 'NT'")).first()[0] == '{"name":"Northern Territory","code":"NT"}'
    with pytest.raises(Exception, match="longer than 3"):
        tables.fit_widths(world["cities"].selectExpr("admin1 AS state"), {"state": 3}).collect()
    assert tables.fit_widths(world["cities"].selectExpr("admin1 AS state"), {"state": 3}, truncate=True).where("length(state) > 3").count() == 0
    options = tables.jdbc_options("t", Settings(jdbc_password="p&w"), "id", (1, 9), 4)
    assert options["url"].startswith("jdbc:mysql://127.0.0.1:3306/") and options["numPartitions"] == "4" and options["password"] == "p&w"


def test_command_norm(spark, capsys):
    assert cli.norm(spark, "Outer Käsdorf") == {"raw": "Outer Käsdorf", "normalized": "OUTER KASDORF", "stripped": "KASDORF"}


def test_settings_are_checked():
    with pytest.raises(ValueError, match="fuzzy_city_min"):
        Settings(fuzzy_city_min=101)


def test_stream(spark, world, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("Inner Ashbrook", "2024-01-01 00:00:00"), ("nowhere", "2024-01-01 00:01:00"), ("dunmore-", "2024-01-01 00:02:00")], "q string, t string").selectExpr("q", "CAST(t AS timestamp) AS t").write.parquet(str(source))
    names = world["localities"].groupBy("norm_key").agg({"locality_id": "min"}).withColumnRenamed("min(locality_id)", "locality_id")
    rows = spark.readStream.schema("q string, t timestamp").parquet(str(source))
    stream.write(stream.look_up(rows, names, "q"), str(out), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.q: r.locality_id for r in spark.read.parquet(str(out)).collect()}
    assert got == {"Inner Ashbrook": 1, "nowhere": None, "dunmore-": None}
    counted = stream.counts_by_window(stream.with_keys(rows, "q"), "t", "norm_key")
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counted").count() == 3
