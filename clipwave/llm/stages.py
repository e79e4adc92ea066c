"""Stages of the corpus pipeline: each calls one operator and lets its decision take effect.

All but the last return the columns of ``docs``.

Edge cases, for all stages: null and empty texts are scored, compared or encoded as empty
ones; very long texts count whole; columns that ``docs`` has beside its own come back as
they were, even if an operator uses such a name, the last stage apart; an empty table gives an
empty one; rows that repeat are judged alike.

* ``quality``: without labels of documents in ``docs`` every score is 0.5, so all stay. A
  score of exactly 0.5 stays.
* ``language``: each text is identified once, and written with what was found, as floors come from all of them. A text without a letter goes. What is left has a language: a null one is
  filled with what was found. Without any labelled text nothing is known, so all goes.
* ``near_duplicates``: rows without an id stay, as do texts without words. Of rows that
  repeat an id all stay or none.
* ``mix``: null sources and languages are values of their own; a text without tokens stays
  once. Null ids draw as one id.
* ``encode``: null texts have no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, gam, jaccard, langid, mixing
from .common import free_name, materialize, table


def aside(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``docs`` with columns that an operator would overwrite under other names; and what brings back the names."""
    back = []
    for c in docs.columns:
        name = c
        if c.lower() in used:
            name = free_name(docs, f"{c}_")
            docs = docs.withColumnRenamed(c, name)
        back.append(F.col(f"`{name}`").alias(c))
    return docs, back


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality classifier gives 0.5 or more; it learns from the labelled ones among them."""
    model = gam.learn(docs, table(spark, sf_dir, "labels"))
    docs, own = aside(docs, ("score",))
    return gam.score(docs, model, keep=True).where("score >= 0.5").select(own)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language: those without a letter, or under the floors of labelled texts of their length, go. A missing language is filled in."""
    profiles = langid.learn(docs)
    docs, own = aside(docs, ("lang_pred", "score", "margin"))
    found = materialize(langid.identify(docs, profiles, keep=True), "identified")
    kept = found.where(langid.known(langid.floors(found)))
    return kept.withColumn("lang", F.coalesce("lang", F.col("lang_pred").cast(docs.schema["lang"].dataType))).select(own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return jaccard.representatives(docs).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the calibrated weights: documents of cells that are wanted more than they have come several times."""
    docs, own = aside(docs, ("topic", "tokens", "probability", "kept", "rate", "copies"))
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.withColumn("copies", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))).select(own)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.round_trip(docs)
