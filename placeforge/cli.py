"""Command line: ``build``, ``check``, ``norm``, ``resolve``, ``golden`` over a folder of published gazetteers."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from placeforge.functions.text import NORM_VERSION, normalize, strip_qualifiers
from placeforge.operators import keys, resolve
from placeforge.plans.build import from_folder, publish_all
from placeforge.sources.tables import ping, read_golden, read_published, settle

TABLES = {"aliases": "alias_norm_key", "localities": "norm_key", "streets": None, "unresolved": None}


def session() -> SparkSession:
    return SparkSession.builder.appName("placeforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def check(spark: SparkSession, folder: str) -> tuple[list[dict], list[str]]:
    """The health report and its problems; no table at all is a problem, too."""
    tables = {name: read_published(spark, f"{folder}/{name}.parquet") for name in TABLES}
    if not any(t is not None for t in tables.values()):
        return [], [f"no table in {folder}"]
    report = [r.asDict() for r in keys.health(tables, {k: v for k, v in TABLES.items() if v}).collect()]
    return report, [p for p in keys.problems(report) if not p.startswith("unresolved ")]


def gazetteers(spark: SparkSession, folder: str) -> resolve.Gazetteers:
    return resolve.Gazetteers(*[read_published(spark, f"{folder}/{t}.parquet") for t in ("localities", "aliases", "streets", "cities", "countries", "states")])


def norm(spark: SparkSession, text: str) -> dict[str, str]:
    row = spark.range(1).select(normalize(F.lit(text)).alias("n")).select("n", strip_qualifiers("n").alias("s")).first()
    return {"raw": text, "normalized": row["n"], "stripped": row["s"]}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="placeforge", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("check").add_argument("folder")
    sub.add_parser("norm").add_argument("text")
    p = sub.add_parser("build", help="build and publish all gazetteers; also after a change of the norm version")
    p.add_argument("source")
    p.add_argument("folder")
    p.add_argument("--snapshot")
    for name in ("resolve", "golden"):
        p = sub.add_parser(name)
        p.add_argument("folder")
        p.add_argument("input", help="a text" if name == "resolve" else "a CSV file of golden cases")
    given = parser.parse_args(args)
    spark = session()
    if given.command == "norm":
        for k, v in norm(spark, given.text).items():
            print(f"{k:<11}{v!r}")
        return 0
    if given.command == "build":
        print(*publish_all(from_folder(spark, given.source, given.snapshot), given.folder), sep="\n")
        return 0
    if given.command == "check":
        report, problems = check(spark, given.folder)
        print(f"norm version {NORM_VERSION}", *[f"{k} {v}" for k, v in ping(spark).items()], *[f"{r['table']:<12}{r['n']}" for r in report], *[f"FAIL {p}" for p in problems], sep="\n")
        return int(bool(problems))
    if given.command == "resolve":
        asked = spark.createDataFrame([(0, given.input)], "id long, text string")
        row = resolve.resolve(asked, gazetteers(spark, given.folder)).drop("id").first()
        print(json.dumps(row.asDict(recursive=True), indent=2))
        return 0
    golden = read_golden(spark, given.input).withColumn("id", F.monotonically_increasing_id())
    got = resolve.resolve(golden.select("id", F.col("input").alias("text")), gazetteers(spark, given.folder))
    cases = settle(resolve.judged(golden, got))
    row = resolve.accuracy(cases).first()
    for r in resolve.failures(cases).collect():  # thirty at most
        print(f"{r['input']!r}: {r['granularity']} {r['country']} {r['admin1']} {r['locality']}")
    print(f"{row['passed']} of {row['cases']} ({row['accuracy']:.1f} %)")
    return int(row["passed"] < row["cases"])


if __name__ == "__main__":
    sys.exit(main())
