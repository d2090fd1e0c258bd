"""The corpus pipeline: quality, near-duplicates, secrets, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and gives back what it keeps; all but
the last return the columns of ``documents``.  ``run`` writes each stage's rows
to the shared folder and reads them again as the next one's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeforge.llm import mixing, nearcopies, pieces, quality, secrets
from placeforge.llm.common import materialise, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier scores below one half.

    Null and empty texts are scored like any other, so are rows of one doc_id
    with other texts; without labels every document has the same score and all
    stay or go; an empty table gives no rows; extra columns go.
    """
    judged = quality.judge(docs, read_table(spark, sf_dir, "labels"), keep=COLUMNS)
    return judged.where("good").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies: that of the smallest doc_id.

    Near copies have a 5-word Jaccard similarity of 0.8 or more, verified:
    SimHash links first, then what they do not reach.  Rows of one doc_id whose
    texts are no near copies all stay; so do rows without a doc_id.  Null, empty
    and blank texts are copies of each other; rows equal in all columns are one;
    an empty table gives no rows; extra columns go.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("key"))
    known = keyed.where("doc_id IS NOT NULL")
    of_class, of_component = nearcopies.near_copies(known.select("key", "text"))
    # per class first, so that a large group of copies does not meet in one task
    least = known.select("key", "doc_id").join(of_class.distinct(), "key").groupBy("class").agg(F.min(F.struct("doc_id", "key")).alias("k"))
    grouped = least.join(of_component, "class", "left").groupBy(F.coalesce("component", "class").alias("component"))
    kept = grouped.agg(F.min("k").alias("k")).select("k.key")
    one = known.join(kept, "key", "left_semi").dropDuplicates(["key"])
    return one.select(*COLUMNS).unionByName(docs.select(*COLUMNS).where("doc_id IS NULL"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; no document goes.

    ``n_chars`` becomes the new length; a null text stays null and keeps its
    ``n_chars``; repeated rows are each cleaned; an empty table gives no rows;
    extra columns go.
    """
    clean = secrets.redacted(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by their rates, four times at most, so that the languages' shares come nearer to each other.

    The targets are chosen so that no rate is below 1: a mixture takes no clean
    document away.  Without labelled documents nothing is repeated; null and
    empty texts, repeated rows and rows of one doc_id fare like any other; an
    empty table gives no rows; extra columns go.
    """
    return mixing.resample(docs.select(*COLUMNS), mixing.labelled_documents(docs, read_table(spark, sf_dir, "labels")), keep_all=True)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, round_trip: the documents as SentencePiece ids.

    A null or empty text has no ids; repeated rows each give a row; an empty
    table gives no rows; all other columns go.
    """
    return pieces.encode(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed_to_targets),
    ("pieces", as_pieces),
]

#: SQL expresses none of these stages; tests/llm/test_pipeline.py runs them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
