"""Recordings as stored segments, and ranges of samples read from them.

A segment is a row with up to ``samples`` consecutive samples of one channel: ``session``,
``chan``, ``first_sample``, ``last_sample`` and ``samples`` (an array; missing ones null). Files lie in a
folder for each session and stretch of ``stretch`` samples, sorted by channel and time. So a range
reads the folders of its stretches alone (partition pruning, also by ranges that are only known at run
time), and in their files the row groups whose least and most channel and sample meet it.

Both ends of a range are included; samples that the store hasn't are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES, STRETCH = 4096, 1 << 20


def segments(rows: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Rows (``session``, ``chan``, ``i``, ``x``) as segments; a sample that comes twice counts once (the smallest value). Gaps are null samples."""
    at = F.floor(F.col("i") / samples)
    once = rows.groupBy("session", "chan", "i").agg(F.min("x").alias("x"))
    held = once.groupBy("session", "chan", at.alias("at")).agg(F.min("i").alias("first_sample"), F.max("i").alias("last_sample"), F.map_from_entries(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x")))).alias("m"))
    filled = F.transform(F.sequence("first_sample", "last_sample"), lambda i: F.try_element_at("m", i))
    return held.select("session", "chan", "first_sample", "last_sample", filled.alias("samples"))


def write_segments(found: DataFrame, path: str, stretch: int = STRETCH, mode: str = "errorifexists") -> None:
    """Store segments. Segments don't cross a stretch if ``stretch`` is a multiple of their samples."""
    placed = found.withColumn("stretch", F.floor(F.col("first_sample") / stretch))
    placed.repartition("session", "stretch").sortWithinPartitions("session", "stretch", "chan", "first_sample").write.partitionBy("session", "stretch").mode(mode).parquet(path)


def meets(first: Column, last: Column, chans: list[int] | None = None) -> Column:
    """Segments of which some sample lies in [first, last]: plain comparisons, which the file reader takes for its row groups."""
    found = (F.col("first_sample") <= last) & (F.col("last_sample") >= first)
    return found & F.col("chan").isin(chans) if chans else found


def read_range(spark: SparkSession, path: str, session: object, first: int, last: int, chans: list[int] | None = None, stretch: int = STRETCH) -> DataFrame:
    """Segments of one session cut to [first, last]."""
    stored = spark.read.parquet(path).where((F.col("session") == F.lit(session)) & F.col("stretch").between(first // stretch, last // stretch))
    return cut(stored.where(meets(F.lit(first), F.lit(last), chans)), F.lit(first), F.lit(last))


def read_ranges(spark: SparkSession, path: str, ranges: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Segments cut to each range (``range``, ``session``, ``first``, ``last``): a join on the folders' columns, so only those that some range meets are read."""
    asked = ranges.where("first <= last").withColumn("stretch", F.explode(F.sequence(F.floor(F.col("first") / stretch), F.floor(F.col("last") / stretch))))
    met = spark.read.parquet(path).join(asked, ["session", "stretch"]).where(meets(F.col("first"), F.col("last")))
    return cut(met, F.col("first"), F.col("last"), ("range",))


def cut(found: DataFrame, first: Column, last: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    start, stop = F.greatest(F.col("first_sample"), first), F.least(F.col("last_sample"), last)
    # The optimiser may ask for the length before the range is tested.
    part = F.slice("samples", (start - F.col("first_sample") + 1).cast("int"), F.greatest(F.lit(0), (stop - start + 1).cast("int")))
    return found.select(*keep, "session", "chan", start.alias("first_sample"), stop.alias("last_sample"), part.alias("samples"))
