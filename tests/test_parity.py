"""The engine's queries against their DuckDB oracles on the smallest test tables."""

import os

import duckdb
import pytest

from placeforge.plans.oracles import ORACLES
from placeforge.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_only_the_resolver_has_no_oracle():
    assert set(QUERIES) - set(ORACLES) == {"resolve_texts"} and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    want = duck.sql(ORACLES[name])
    cols = sorted(found.columns)
    assert sorted(want.columns) == cols
    got = sorted(repr(tuple(r[c] for c in cols)) for r in found.collect())
    assert got == sorted(map(repr, want.project(", ".join(f'"{c}"' for c in cols)).fetchall()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
