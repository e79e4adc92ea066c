"""Training-corpus pipeline over ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clipwave.llm import stages
from clipwave.llm.common import materialize, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", stages.quality),
    ("language id", stages.language),
    ("n-gram jaccard join", stages.near_duplicates),
    ("source mixing", stages.mix),
    ("bpe round trip", stages.encode),
]

#: Models are fitted and texts are tokenised on the way: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to all that its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
