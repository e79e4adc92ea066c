"""Annotations as they arrive: an upsert for each micro-batch that can be repeated.

Each batch becomes a version of its own, a folder ``version=<batch id>`` that is written whole, so a
batch that comes again after a failure replaces what it had written and changes nothing. Within a
batch the latest row of each key is kept. The current table is the row with the greatest
order of each key over all versions; ``compact`` writes it as one version and leaves the earlier ones
out, for readers that begin afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import latest_wins


def upsert_batch(path: str, keys: tuple[str, ...], order: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls."""

    def write(batch: DataFrame, number: int) -> None:
        latest_wins(batch, keys, order).write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def follow(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...], order: str) -> None:
    """Take what is new in a stream of annotations."""
    stream.writeStream.foreachBatch(upsert_batch(path, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, path: str, keys: tuple[str, ...], order: str) -> DataFrame:
    """The current row of each key; of rows with the same order the later version's."""
    log = spark.read.parquet(path)
    turn = F.struct(F.col(order), F.col("version"))
    return latest_wins(log.withColumn("turn_", turn), keys, "turn_").drop("turn_", "version")


def compact(spark: SparkSession, path: str, to: str, keys: tuple[str, ...], order: str) -> None:
    """The current table as one version of a new folder, numbered like the latest."""
    last = spark.read.parquet(path).agg(F.max("version")).first()[0]
    current(spark, path, keys, order).write.mode("overwrite").parquet(f"{to}/version={last}")
