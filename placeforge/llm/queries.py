"""The queries of the corpus operators, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeforge.llm import lm, mixing, mtree, pieces, pstable, quality, tokens, urls
from placeforge.llm.common import read_table
from placeforge.llm.secrets import find_secrets
from placeforge.llm.simhash import near_duplicates


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.recount(tokens.build_trees(read_table(spark, sf_dir, "documents")))
    return counted.select("doc_id", F.col("tokens_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_edited"), "encoded_chars")


RULES = ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"]


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"), urls.parse_rules(RULES))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    one = F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return find_secrets(read_table(spark, sf_dir, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"), "base_sha256", F.array_join(one, ",").alias("spans"), count("lexed")
    )


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return pstable.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op8_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read_table(spark, sf_dir, "documents"))


def op9_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return mtree.search(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.labelled_documents(docs, read_table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tokens": op1_tokens,
    "op2_urls": op2_urls,
    "op3_secrets": op3_secrets,
    "op4_pieces": op4_pieces,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_pstable": op7_pstable,
    "op8_mixing_lm": op8_mixing_lm,
    "op9_mtree": op9_mtree,
    "op10_mixing": op10_mixing,
}

#: The whole numbers' products are exact in either engine.
_OP9 = """
WITH good AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS y
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.y AS DOUBLE[]), CAST(c.y AS DOUBLE[])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.y) = len(c.y)
), once AS (
  SELECT query_id, vec_id, max(score) AS score FROM pairs GROUP BY query_id, vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM once
QUALIFY rank <= 5
"""

ORACLES: dict[str, str] = {"op9_mtree": _OP9}
