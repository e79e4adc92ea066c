"""Patterns over rows of windows: run rule, runs, votes, hysteresis, event merging, nearest matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import energy_ratio, true_if

LOWEST = float("-inf")


def run_minimum(z: DataFrame, n: int = 3, clip: str = "clip", chan: str = "chan", win: str = "win") -> DataFrame:
    """``run_min``: the least valid z of n windows from here on; minus infinity where one is invalid or missing."""
    frame = Window.partitionBy(clip, chan).orderBy(win).rowsBetween(0, n - 1)
    held = F.when(true_if(F.col("valid")), F.col("z")).otherwise(F.lit(LOWEST))
    low = F.min(F.coalesce(held, F.lit(LOWEST))).over(frame)
    return z.withColumn("run_min", F.when(F.count("*").over(frame) == n, low).otherwise(F.lit(LOWEST)))


def run_score(z: DataFrame, n: int = 3, clip: str = "clip", chan: str = "chan", win: str = "win") -> DataFrame:
    """Best run of each clip: ``score``, its channel and first window (null if there is no run). Ties: first channel, then earliest."""
    best = F.max_by(F.struct(chan, win), F.struct(F.col("run_min"), -F.col(chan), -F.col(win)))
    out = run_minimum(z, n, clip, chan, win).groupBy(clip).agg(F.max("run_min").alias("score"), best.alias("b"))
    some = F.col("score") > LOWEST
    return out.select(clip, "score", F.when(some, F.col(f"b.{chan}")).alias("chan"), F.when(some, F.col(f"b.{win}")).alias("onset_win"))


def detect(scores: DataFrame, threshold: float = 4.0) -> DataFrame:
    """``detected`` (strictly above the threshold); onset and channel only then."""
    hit = F.col("score") > threshold
    return scores.select("clip", "score", hit.alias("detected"), F.when(hit, F.col("chan")).alias("chan"), F.when(hit, F.col("onset_win")).alias("onset_win"))


def runs(rows: DataFrame, flag: Column, keys: tuple[str, ...], order: str) -> DataFrame:
    """Maximal runs of true: ``start``, ``stop`` and ``length``. ``order`` counts up by one."""
    w = Window.partitionBy(*keys).orderBy(order)
    island = rows.where(true_if(flag)).withColumn("island", F.col(order) - F.row_number().over(w))
    return island.groupBy(*keys, "island").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count("*").alias("length")).drop("island")


def detected_span(run_rows: DataFrame, scores: DataFrame, clip: str = "clip", chan: str = "chan") -> DataFrame:
    """The run of the detected channel that holds the onset."""
    s = scores.where("detected").select(clip, F.col("chan").alias(chan), "onset_win")
    return run_rows.join(s, [clip, chan]).where("onset_win between start and stop").select(clip, chan, "start", "stop")


def near_misses(run_rows: DataFrame, n: int = 3) -> DataFrame:
    return run_rows.where((F.col("length") >= 1) & (F.col("length") < n))


def classify(truth: Column, predicted: Column, evaluable: Column) -> Column:
    """excluded, TP, FN, FP or TN."""
    return F.when(~true_if(evaluable), "excluded").when(truth & predicted, "TP").when(truth, "FN").when(predicted, "FP").otherwise("TN")


def agreement(truth: Column, detected: Column) -> Column:
    """Where annotation and detector name a channel: both, truth, detector or none."""
    return F.when(truth & detected, "both").when(truth, "truth").when(detected, "detector").otherwise("none")


def votes(rows: DataFrame, above: Column, n: int, least: int, keys: tuple[str, ...], order: str) -> DataFrame:
    """``votes`` among the last n rows, and whether over ``least`` of them are true."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    count = F.sum(true_if(above).cast("long")).over(frame)
    return rows.withColumn("votes", count).withColumn("voted", F.col("votes") > least)


def cool_down(rows: DataFrame, above: Column, saturated: Column, seconds: float, keys: tuple[str, ...], time: str) -> DataFrame:
    """``above`` where no saturation lies less than ``seconds`` back (the row's own counts)."""
    frame = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(true_if(saturated), F.col(time))).over(frame)
    return rows.withColumn("cooled", true_if(above) & ~true_if(F.col(time) - last < seconds))


def baseline_ratio(rows: DataFrame, power: str, keys: tuple[str, ...], order: str, rows_all: int = 100, rows_kept: int = 50) -> DataFrame:
    """Power over the mean of the oldest ``rows_kept`` of the ``rows_all`` rows before, which were silent (0) before the first."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows_all, -(rows_all - rows_kept + 1))
    mean = F.coalesce(F.sum(power).over(frame), F.lit(0.0)) / rows_kept
    return rows.withColumn("ratio", energy_ratio(F.col(power), mean))


def first_per(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key; ties by the other columns. Aggregated, so a hot key sends one row for each task."""
    others = [c for c in rows.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *others)).alias("x")
    return rows.groupBy(*keys).agg(first).select(*(F.col(c if c in keys else f"x.{c}") for c in rows.columns))


def schmitt(rows: DataFrame, power: str, on: float, off: float, keys: tuple[str, ...], order: str) -> DataFrame:
    """``on``: true from a row above ``on`` until one under ``off``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    edge = F.when(F.col(power) > on, F.lit(True)).when(F.col(power) < off, F.lit(False))
    return rows.withColumn("on", F.coalesce(F.last(edge, ignorenulls=True).over(w), F.lit(False)))


# Events: rows with ``on`` and ``off`` in seconds


def merge_events(events: DataFrame, gap: float, keys: tuple[str, ...], kind: str) -> DataFrame:
    """Neighbouring events of one kind become one where the next begins less than ``gap`` after the latest end so far.

    Two passes: a run ends where the kind changes, and within a run where the gap is reached."""
    w = Window.partitionBy(*keys).orderBy("on", "event")
    change = F.coalesce((F.col(kind) != F.lag(kind).over(w)).cast("int"), F.lit(1))
    run = events.withColumn("change_", change).withColumn("run_", F.sum("change_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "run_").orderBy("on", "event")
    latest = F.max("off").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    islands = run.withColumn("new_", F.coalesce((F.col("on") - latest >= gap).cast("int"), F.lit(0)))
    islands = islands.withColumn("island_", F.sum("new_").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "run_", "island_").agg(F.first(kind).alias(kind), F.min("on").alias("on"), F.max("off").alias("off"), F.count("*").alias("merged")).drop("run_", "island_")


def next_onset(events: DataFrame, keys: tuple[str, ...], least: float = 1e-6) -> DataFrame:
    """``next_on``: the first onset over ``least`` after an event's end; infinite if none.

    Forward as-of by one sort of ends and onsets together, not a join of all pairs."""
    cols = [c for c in events.columns if c not in keys]
    ends = events.select(*keys, (F.col("off") + least).alias("at_"), F.lit(0).alias("side_"), F.struct(*cols).alias("e_"))
    ons = events.select(*keys, F.col("on").alias("at_"), F.lit(-1).alias("side_"), F.lit(None).cast(ends.schema["e_"].dataType).alias("e_"))
    # From the end on: a frame up to the end would be gone through anew for each row.
    later = Window.partitionBy(*keys).orderBy(F.desc("at_"), F.desc("side_")).rowsBetween(Window.unboundedPreceding, -1)
    found = F.min(F.when(F.col("side_") == -1, F.col("at_"))).over(later)
    both = ends.union(ons).withColumn("next_on", F.coalesce(found, F.lit(float("inf"))))
    return both.where("side_ = 0").select(*keys, "e_.*", "next_on")


def nearest(events: DataFrame, marks: DataFrame, keys: tuple[str, ...], low: float, high: float) -> DataFrame:
    """For each event (``event``, ``on``) the mark (``mark``, ``at``) nearest in time; one within (low, high) of the onset goes before any other. Ties: the earliest mark.

    Marks before and after an event come from running extremes over one sort of both."""
    e = events.select(*keys, F.col("on").alias("t_"), F.lit(1).alias("side_"), "event", F.lit(None).cast("long").alias("mark"))
    m = marks.groupBy(*keys, "at").agg(F.min("mark").alias("mark")).select(*keys, F.col("at").alias("t_"), F.lit(0).alias("side_"), F.lit(None).cast("long").alias("event"), "mark")
    w, back = Window.partitionBy(*keys).orderBy("t_", "side_", "mark"), Window.partitionBy(*keys).orderBy(F.desc("t_"), F.desc("side_"), F.desc("mark"))
    mark = F.when(F.col("side_") == 0, F.struct(F.col("t_").alias("at"), "mark"))
    both = e.union(m).withColumns({"before_": F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "after_": F.last(mark, True).over(back.rowsBetween(Window.unboundedPreceding, -1))})
    dt = lambda c: F.col(f"{c}.at") - F.col("t_")
    option = lambda c: F.when(F.col(c).isNotNull(), F.struct((~((dt(c) > low) & (dt(c) < high))).cast("int").alias("out"), F.abs(dt(c)).alias("away"), F.col(f"{c}.at").alias("at"), F.col(f"{c}.mark").alias("mark")))
    best = F.array_min(F.filter(F.array(option("before_"), option("after_")), lambda x: x.isNotNull()))
    return both.where("side_ = 1").withColumn("b_", best).select(*keys, "event", F.col("t_").alias("on"), F.col("b_.mark").alias("mark"), F.col("b_.at").alias("at"))


def within(points: DataFrame, spans: DataFrame, keys: tuple[str, ...], t: str, start: str, stop: str, bucket: float) -> DataFrame:
    """Points inside spans, both ends included: an equi-join on time buckets, then the exact test."""
    b = points.withColumn("bucket_", F.floor(F.col(t) / bucket))
    s = spans.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(stop) / bucket))))
    return b.join(s, [*keys, "bucket_"]).where((F.col(t) >= F.col(start)) & (F.col(t) <= F.col(stop))).drop("bucket_")
