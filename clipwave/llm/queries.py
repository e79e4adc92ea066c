"""One query for each corpus operator, over its whole table, and the pipeline.

Each query gets its rows through its operator and returns the digest that a reader can
check; the operators have wider interfaces of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, gam, jaccard, kdsearch, langid, mixing, negatives, packing, rules, sharding, tokencounts, variants
from .common import fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs, where=fold("doc_id", 5) != 0)
    found = langid.identify(docs, profiles)
    return found.withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "margin")


def op2_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.histogram(tokencounts.lengths(table(spark, sf_dir, "documents")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.windows(chat.with_probe(spark, table(spark, sf_dir, "conversations"))))


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = gam.score(docs, gam.learn(docs, labels, where=fold("doc_id", 3) != 1))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdsearch.top_k(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document comes in a sample that meets the targets."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "topic", "tokens", F.round("rate", 6).alias("rate"), "copies")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = rules.apply(docs, rules.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), anchors=F.col("vec_id") % 50 == 0)


def op13_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


OPERATORS = (
    op1_language_id, op2_token_histogram, op3_jaccard_join, op4_chat_windows, op5_quality_gam, op6_bpe_round_trip, op7_exact_top_k, op8_source_mixing, op9_quality_rules, op10_kd_shards,
    op11_spelling_variants, op12_hard_negatives, op13_sum_of_squares_packing,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_windows": chat.ORACLE_SQL, "op8_source_mixing": mixing.oracle(), "op12_hard_negatives": negatives.ORACLE_SQL}
