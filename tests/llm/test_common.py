from placeforge.llm import common


def test_words_split_at_the_six_separators():
    assert common.words_of("A\tb\x0bC\x0c\r\n \x1cd\x85e\xa0É") == [b"a", b"b", b"c", "\x1cd\x85e\xa0É".encode()]
    assert common.words_of(None) == [] == common.words_of(" \n")


def test_tables_can_be_removed(spark):
    common.remove_tables(spark)
    kept = common.materialise(spark.range(5), "some")
    assert kept.count() == 5 and common.remove_tables(spark) == 1
    assert common.remove_tables(spark) == 0


def test_hash_is_uniform(spark):
    row = spark.range(4000).select(common.unit_hash("id").alias("u")).selectExpr("min(u)", "max(u)", "avg(u)").first()
    assert 0 <= row[0] < 0.01 and 0.99 < row[1] < 1 and abs(row[2] - 0.5) < 0.02


def test_join_by_count_is_the_plain_join(spark):
    rows = spark.createDataFrame([(k % 7 if k % 2 else 99, k) for k in range(900)], "key long, at long")
    of_key = rows.groupBy("key").count().where("key <> 3")
    got = common.join_by_count(rows, of_key, "key", "count", 900)
    assert sorted(map(tuple, got.select("key", "at", "count").collect())) == sorted(map(tuple, rows.join(of_key, "key").select("key", "at", "count").collect()))
    assert of_key.where("count > 100").count() == 1
    assert common.join_by_count(rows.limit(0), of_key, "key", "count", 0).count() == 0
