from decimal import Decimal

import pytest

from placeforge.operators import alias, keys, locality, street
from placeforge.plans.build import Build
from placeforge.schemas import ADDRESS, POSTCODES, STATE_BUCKET


def address(pid, state="NSW", place="Ryde", postcode="2112", name="Hamilton", kind="Cr", suffix=None, lat="-33.8", lng="151.1", principal=None):
    return (pid, principal, "ALIAS" if principal else "PRINCIPAL", state, place, postcode, name, kind, suffix, lat, lng)


ROWS = [
    address("1"), address("2", kind="CR "), address("3", name="Hamilton Cr", kind=""), address("4", name=" hamilton", kind="cr", lat="", lng=" "),
    address("5", lat="-33.9", lng=""), address("6", postcode="800"), address("7", postcode=None), address("8", place="  "), address("9", name=""),
    address("10", state="vic", place="Ryde", postcode="3999", name="Main", kind="St", lat="-37.0", lng="145.0"),
    address("11", place="North Ryde", principal="1"), address("12", place="Old Town", principal="10", state="VIC", postcode="3999"),
    address("13", place="Nowhere", postcode="2112", name="Long", kind="Rd", lat="", lng=""),
    address("14", state="OT", place="Island", postcode="6799", name="Reef", kind="Rd", lat="-12.0", lng="96.8"),
    address("15", state="WA", place="Far", postcode="6000", name="Off", kind="Rd", lat="-60.0", lng="120.0"),
]


@pytest.fixture(scope="module")
def build(spark):
    posts = [
        (2, "2112", "Ryde ", "NSW", "-33.80", "151.10", "Delivery Area", "S2", "S3", " ", "L", "R1"), (1, "2112", "RYDE", "nsw", "", "", "", "A2", "", "", "", ""),
        (3, "2112", "Ryde East", "NSW", "-33.81", "151.11", "Delivery Area", "", "", "", "", ""), (4, "800", "Darwin", "NT", "-12.4", "130.8", "PO Boxes", "", "", "", "", ""),
        (5, "30011", "Cut", "VIC", "", "", "", "", "", "", "", ""), (6, "", "None", "VIC", "", "", "", "", "", "", "", ""), (7, "2112", "OLD RYDE", "NSW", "", "", "", "", "", "", "", ""),
    ]
    bucket = [("NSW RYDE", "NSW"), ("NSW Ryde East ", "NSW"), ("NSWRYDE", "NSW"), ("NSW ", "NSW"), ("VIC RYDE", "VIC"), ("OLD RYDE", "OLD")]
    return Build(spark.createDataFrame(ROWS, ADDRESS), spark.createDataFrame(posts, POSTCODES), spark.createDataFrame(bucket, STATE_BUCKET), snapshot_id="t")


def by(df, *key):
    return {tuple(r[k] for k in key): r for r in df.collect()}


def test_variants_and_canonical_form(build):
    forms = by(build.variants.where("street_key = 'HAMILTON CR' AND locality = 'RYDE'"), "street_name", "street_type")
    assert {k: v.n for k, v in forms.items()} == {("HAMILTON", "CR"): 4, ("HAMILTON CR", ""): 1}
    assert forms["HAMILTON", "CR"].geo_n == 2 and forms["HAMILTON", "CR"].lat_sum == Decimal("-101.50000000")
    row = by(build.streets, "state", "locality", "postcode", "street_key")["NSW", "RYDE", "2112", "HAMILTON CR"]
    assert (row.street_name, row.street_type, row.address_count) == ("HAMILTON", "CR", 5)
    assert row.lat == Decimal("-45.1000000")  # three sums over two: a lone latitude counts above, not below
    assert row.lng == Decimal("151.1000000")


def test_corrected_centroids(build):
    own = Build(build.addresses, build.postcodes, build.bucket, corrected=True)
    row = by(own.streets, "street_key", "locality")["HAMILTON CR", "RYDE"]
    assert row.lat == Decimal("-33.8000000") and row.address_count == 5


def test_ties_prefer_typed_forms(spark):
    rows = spark.createDataFrame([address("1", name="Hamilton Cr", kind=""), address("2")], ADDRESS)
    assert street.canonical(street.variants(rows)).first().street_type == "CR"


def test_street_checks(build):
    assert street.conservation(build.streets, build.addresses).first()[:] == (11, 11)
    assert street.blank_coordinates(build.addresses).first()[0] == 3
    assert street.merged_keys(build.variants).first()[0] == 1
    s = street.summary(build.streets).first()
    assert (s.street_rows, s.rows_without_geometry) == (7, 1)
    assert street.out_of_bounds(build.streets).first()[0] == 2  # -60, and the biased -45.1; state OT is left out
    clash = {r.street_key: r for r in street.collisions(build.addresses).where("locality_name = 'Ryde' AND postcode = '2112'").collect()}
    assert clash["HAMILTON CR"].variants == 2 and clash["HAMILTON CR"].forms == "[Hamilton|Cr|] [Hamilton Cr||]"
    assert street.discarded(build.variants).first().street_name == "HAMILTON CR"


def test_localities(build):
    rows = by(build.localities, "state", "locality", "postcode")
    ryde = rows["NSW", "RYDE", "2112"]
    assert (ryde.geo_source, ryde.in_gnaf, ryde.in_auspost, ryde.is_postal_only) == ("gnaf", True, True, False)
    assert ryde.sa2_name == "A2" and ryde.delivery_type is None  # the first id wins, blanks are null
    assert ryde.address_count == 6 and ryde.norm_key == "RYDE" and ryde.snapshot_id == "t"
    empty = rows["NSW", "NOWHERE", "2112"]
    assert empty.lat is None and empty.geo_source == "gnaf"
    assert rows["NT", "DARWIN", "0800"].geo_source == "auspost" and rows["NT", "DARWIN", "0800"].is_postal_only
    assert rows["VIC", "CUT", "3001"].geo_source == "none"
    assert rows["NT", "DARWIN", "0800"].street_count == 0 and ryde.street_count == 1
    # padding comes before the test of four digits here: a blank postcode becomes 0000 and stays
    assert ("VIC", "NONE", "0000") in rows and not any(k[2] == "0800" and k[0] == "NSW" for k in rows)
    assert len({r.locality_id for r in rows.values()}) == len(rows)


def test_postcode_centroid_bias(build):
    own = build.with_addresses
    ryde = own.where("locality = 'RYDE' AND state = 'NSW'").first()
    biased = by(locality.postcode_centroids(own), "state", "postcode")["NSW", "2112"]
    right = by(locality.postcode_centroids(own, corrected=True), "state", "postcode")["NSW", "2112"]
    assert float(biased.lat) == pytest.approx(float(ryde.lat) * 6 / 7, abs=1e-6)
    assert right.lat == ryde.lat


def test_merge_is_union_of_left_and_anti_join(build):
    own, centroids = build.with_addresses, locality.postcode_centroids(build.with_addresses)
    a = locality.merge(own, centroids, build.posts, "t")
    b = locality.merge_by_union(own, centroids, build.posts, "t")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_ambiguous_names(build):
    got = locality.ambiguous(build.places).collect()
    assert [(r.locality, r.states, r.state_list) for r in got] == [("RYDE", 2, "NSW,VIC")]
    assert locality.provenance(build.places).first()[:] == (10, 5, 6, 5, 3)


def test_aliases_and_precedence(build, spark):
    places = build.places
    ids = {v: k for k, v in ((r.locality_id, (r.state, r.locality, r.postcode)) for r in places.collect())}
    names = {v: k for k, v in ids.items()}
    named = lambda df: {(r.alias_display, names[r.locality_id], r.alias_type) for r in df.collect()}
    a = alias.from_principals(build.addresses, places)
    assert named(a) == {("NORTH RYDE", ("NSW", "RYDE", "2112"), "gnaf_alias"), ("OLD TOWN", ("VIC", "RYDE", "3999"), "gnaf_alias")}
    b = alias.from_state_bucket(build.bucket, places)
    assert named(b) == {("NSW RYDE", ("NSW", "RYDE", "2112"), "state_bucket"), ("NSW RYDE EAST", ("NSW", "RYDE EAST", "2112"), "state_bucket"), ("VIC RYDE", ("VIC", "RYDE", "3999"), "state_bucket")}
    c = alias.from_postal_variants(build.posts, places, build.with_addresses)
    assert named(c) == {(x, ("NSW", y, "2112"), "auspost_variant") for x in ("RYDE EAST", "OLD RYDE") for y in ("RYDE", "NOWHERE")}
    ryde = ids["NSW", "RYDE", "2112"]
    same = lambda kind, trust: spark.createDataFrame([("X", ryde, kind, Decimal(trust))], "alias_display string, locality_id long, alias_type string, confidence decimal(3,2)")
    kept = alias.combine(same("auspost_variant", "0.80"), same("state_bucket", "0.95"), same("gnaf_alias", "1.00")).collect()
    assert [(r.alias_type, r.confidence) for r in kept] == [("gnaf_alias", Decimal("1.00"))]
    manual = spark.createDataFrame([("THE RYDE" + "E" * 120, "NSW", "RYDE", "2112", 1.0)], "alias_display string, state string, locality string, postcode string, confidence double")
    own = Build(build.addresses, build.postcodes, build.bucket, manual, "t")
    back = alias.export_manual(own.aliases, places).collect()
    assert len(back) == 1 and len(back[0].alias_display) == 96 and back[0].locality == "RYDE"
    assert {r.alias_display: r.targets for r in alias.collisions(own.aliases).collect()} == {"RYDE EAST": 2, "OLD RYDE": 2}


def test_keys(spark):
    rows = spark.createDataFrame([(1, "Ryde", None, "1"), (2, "Perth", "", "1"), (3, "Old", "KEEP", "0"), (4, "東京", None, "1")], "id int, name string, norm_key string, norm_version string")
    assert keys.verify({"t": (rows, "norm_key")}).first()[:] == ("t", 3, 1, False)
    filled = {r.id: (r.norm_key, r.norm_version) for r in keys.backfill(rows, "name", "norm_key").collect()}
    assert filled == {1: ("RYDE", "1"), 2: ("PERTH", "1"), 3: ("KEEP", "0"), 4: ("", "1")}
    again = keys.backfill(rows, "name", "norm_key", only_missing=False)
    assert keys.verify({"t": (again, "norm_key")}).first()[:] == ("t", 1, 0, False)
    report = [r.asDict() for r in keys.health({"a": rows, "b": None}, {"a": "norm_key"}).collect()]
    assert report == [{"table": "a", "n": 4, "key_missing": 3}, {"table": "b", "n": None, "key_missing": None}]
    assert keys.problems(report) == ["b is not there", "a has 3 rows without a key"]


def test_empty_tables(spark, build):
    own = Build(build.addresses.limit(0), build.postcodes.limit(0), build.bucket.limit(0))
    assert own.streets.count() == own.localities.count() == own.aliases.count() == 0
    assert street.conservation(own.streets, own.addresses).first()[:] == (None, 0)


def test_plans_push_down_and_prune(build, spark, tmp_path):
    build.addresses.write.parquet(str(tmp_path / "a"))
    own = Build(spark.read.parquet(str(tmp_path / "a")), build.postcodes, build.bucket)
    plan = own.streets._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("ReadSchema") :]
    assert "principal_pid" not in scan and "alias_principal" not in scan
    assert plan.count("FileScan") == 1 and "Join" not in plan
