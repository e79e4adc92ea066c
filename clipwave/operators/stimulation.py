"""The streaming detector as DataFrame plans: stimulations, frozen baselines, votes with resets.

Rows are windows of a channel in order: ``i`` counts them up by one, ``t`` is their time and
``power`` what is compared with thresholds; null power counts as 0. What a state machine would carry
from row to row is worked out for all rows at once:

* **Onsets** (``stimulations``). While the channel is off, rows above the upper threshold
  vote; enough votes among the last rows, none of them before the latest end, are an onset, if
  the onset before is far enough back; the stimulation ends at the next row under the lower
  threshold. Which onset follows depends on the one before, so each row that could be an
  onset (a *candidate*: enough votes among the last rows, however old) gets a link to the
  onset that would follow it. With c votes up to its end, that is the first candidate
  from the row on that casts vote c + least, and later than the separation: two as-of look-ups.
  The links that are taken from the first candidate on are found by pointer doubling, in as many
  rounds as the number of a channel's onsets has binary digits.
* **States** (``detector_rows``). A row's state follows from the onsets and ends before it. The
  baseline is a mean over ranks of the off rows only, a difference of two running totals, and
  frozen at the latest onset.
* **Votes with resets**. A vote count since the latest reset within the last rows is a
  difference of running totals, too: totals never fall, so the total at the later of two rows is
  the larger of the two.

Every window runs over a channel from its start to the row; none looks ahead or is recomputed for
each row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import energy_ratio, true_if
from ..sources.shared import written
from .patterns import first_per


@dataclass(frozen=True)
class Rule:
    """Thresholds; ``rows`` are numbers of windows, ``seconds`` times. Defaults are fixed values of the detector (windows of 20 ms)."""

    on: float = 1e9
    off: float = 1e7
    vote_rows: int = 15
    vote_least: int = 8
    separation_seconds: float = 0.5
    baseline_rows: int = 100
    baseline_kept: int = 50
    look_seconds: float = 5.0
    ratio: float = 30.0
    saturation: float = 1e4
    cool_seconds: float = 2.0
    history_rows: int = 100
    history_least: int = 11


def so_far(keys: tuple[str, ...], stop: int = 0):  # noqa: ANN201
    """All rows of the channel up to the current one (``stop`` -1: without it)."""
    return Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, stop)


def backwards(keys: tuple[str, ...], *order: Column):  # noqa: ANN201
    """All rows of the channel behind the current one, from its end on: a frame that grows as the window moves, as frames that end at the end don't."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def first_at(asked: DataFrame, nodes: DataFrame, keys: tuple[str, ...], at: str, node_at: str, out: str) -> DataFrame:
    """``asked`` with ``out``: the first node (by ``i``) whose ``node_at`` isn't under ``at``; null where there is none or ``at`` is null. Forward as-of by one sort of both."""
    cols = [c for c in asked.columns if c not in keys]
    a = asked.select(*keys, F.col(at).alias("at_"), F.lit(1).alias("side_"), F.lit(None).cast("long").alias("node_"), F.struct(*cols).alias("row_"))
    n = nodes.select(*keys, F.col(node_at).alias("at_"), F.lit(0).alias("side_"), F.col("i").cast("long").alias("node_"), F.lit(None).cast(a.schema["row_"].dataType).alias("row_"))
    # From the end: nodes come after (so before, here) what is asked at the same place.
    seen = F.min("node_").over(backwards(keys, F.col("at_").desc_nulls_first(), F.col("side_")))
    both = a.union(n).withColumn("found_", F.when(F.col("at_").isNotNull(), seen)).where("side_ = 1")
    return both.select(*keys, "row_.*", F.col("found_").alias(out))


def candidates(rows: DataFrame, rule: Rule, keys: tuple[str, ...]) -> DataFrame:
    """``above``, ``cast`` (votes up to the row) and ``votes`` (among the last rows) of every row."""
    above = true_if(F.col("power") > rule.on).cast("long")
    w = Window.partitionBy(*keys).orderBy("i")
    rows = rows.withColumn("above", above).withColumn("cast", F.sum("above").over(so_far(keys)))
    return rows.withColumn("votes", F.col("cast") - F.coalesce(F.lag("cast", rule.vote_rows).over(w), F.lit(0)))


def stimulations(rows: DataFrame, rule: Rule, keys: tuple[str, ...] = ("chan",)) -> DataFrame:
    """``on_i``, ``on``, ``off_i`` and ``off`` (null while it lasts) of each stimulation. ``rows``: keys, i, t, power."""
    rows = candidates(rows.select(*keys, "i", "t", "power"), rule, keys)
    low = true_if(F.coalesce("power", F.lit(0.0)) < rule.off)
    end = F.when(low, F.struct("i", "t", "cast"))
    ends = F.last(end, ignorenulls=True).over(backwards(keys, F.col("i").desc()))
    voted = written(rows.withColumn("end", ends), "stimulation-rows")
    nodes = voted.where(F.col("votes") >= rule.vote_least).select(*keys, "i", "t", "end")
    # The row that casts the vote that is needed after the end.
    casts = voted.where("above = 1").select(*keys, F.col("cast").alias("needed"), F.col("i").alias("cast_i"))
    asked = nodes.select(*keys, "i", (F.col("end.cast") + rule.vote_least).alias("needed"), (F.col("t") + rule.separation_seconds).alias("until"))
    asked = asked.join(casts, [*keys, "needed"], "left").drop("needed")
    later = nodes.select(*keys, "i", "t")
    asked = first_at(asked, later, keys, "cast_i", "i", "by_votes")
    # Strictly later than the separation: the next double.
    asked = first_at(asked.withColumn("until", after(F.col("until"))), later, keys, "until", "t", "by_time")
    links = asked.where("by_votes is not null and by_time is not null").select(*keys, "i", F.greatest("by_votes", "by_time").alias("next"))
    first = nodes.groupBy(*keys).agg(F.min("i").cast("long").alias("i"))
    taken = followed(first, links, keys)
    return taken.join(nodes, [*keys, "i"]).select(*keys, F.col("i").alias("on_i"), F.col("t").alias("on"), F.col("end.i").alias("off_i"), F.col("end.t").alias("off"))


def after(t: Column) -> Column:
    """More than t by less than any two times differ: a relative step of the size of a double's last digits."""
    return t + F.greatest(F.abs(t), F.lit(1.0)) * F.lit(2.0**-51)


def followed(first: DataFrame, links: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The nodes (``i``) that are reached from ``first`` by ``links`` (i, next), by pointer doubling."""
    links, taken, count = written(links, "stimulation-links"), written(first, "stimulation-taken"), -1
    while (now := taken.count()) != count:
        count = now
        step = taken.join(links, [*keys, "i"]).select(*keys, F.col("next").alias("i"))
        taken = written(taken.union(step).distinct(), "stimulation-taken")
        on = links.select(*keys, F.col("i").alias("next"), F.col("next").alias("after"))
        links = written(links.join(on, [*keys, "next"]).select(*keys, "i", F.col("after").alias("next")), "stimulation-links")
    return taken


def detector_rows(rows: DataFrame, found: DataFrame, rule: Rule, keys: tuple[str, ...] = ("chan",)) -> DataFrame:
    """Every row with ``stim`` (the number of its channel's latest onset, 0 before the first), ``is_on`` and ``look`` (before the row), ``baseline``, ``ratio``, ``above`` and ``votes``.

    ``found``: what ``stimulations`` gave for the same rows."""
    marks = found.select(*keys, F.col("on_i").alias("i"), F.lit(True).alias("begins")).union(found.where("off_i is not null").select(*keys, F.col("off_i"), F.lit(False)))
    rows = rows.select(*keys, "i", "t", F.coalesce("power", F.lit(0.0)).alias("power")).join(marks, [*keys, "i"], "left")
    now, before = so_far(keys), so_far(keys, -1)
    rows = rows.withColumns({
        "stim": F.sum(true_if(F.col("begins")).cast("int")).over(now),
        "is_on": F.coalesce(F.last("begins", ignorenulls=True).over(before), F.lit(False)),
        "ended": F.max(F.when(~F.col("begins"), F.col("t"))).over(before),
    })
    rows = rows.withColumn("look", ~F.col("is_on") & F.col("ended").isNotNull() & ~true_if(F.col("t") > F.col("ended") + rule.look_seconds))
    # Ranks count off rows alone.
    off_rows = Window.partitionBy(*keys, "is_on").orderBy("i")
    rows = rows.withColumn("sum_", F.sum("power").over(off_rows.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda back: F.coalesce(F.lag("sum_", back).over(off_rows), F.lit(0.0))
    mean = (at(rule.baseline_rows - rule.baseline_kept + 1) - at(rule.baseline_rows + 1)) / rule.baseline_kept
    rows = rows.withColumn("mean_", F.when(true_if(F.col("begins")), mean))
    rows = rows.withColumn("baseline", F.last("mean_", ignorenulls=True).over(now))
    watched = F.col("is_on") | F.col("look")
    rows = rows.withColumn("ratio", F.when(watched, energy_ratio(F.col("power"), F.col("baseline"))))
    saturated = F.max(F.when(true_if(F.col("ratio") > rule.saturation), F.col("t"))).over(now)
    fit = true_if((F.col("ratio") > rule.ratio) & (F.col("ratio") < rule.saturation))
    rows = rows.withColumn("saturated_", saturated).withColumn("above", fit & ~true_if(F.col("t") - F.col("saturated_") < rule.cool_seconds))
    # Votes since the latest row that isn't looked at, among the last rows.
    w = Window.partitionBy(*keys).orderBy("i")
    rows = rows.withColumn("total_", F.sum((F.col("above") & F.col("look")).cast("int")).over(now))
    reset = F.coalesce(F.max(F.when(~F.col("look"), F.col("total_"))).over(now), F.lit(0))
    old = F.coalesce(F.lag("total_", rule.history_rows).over(w), F.lit(0))
    rows = rows.withColumn("votes", F.col("total_") - F.greatest(reset, old))
    return rows.drop("begins", "ended", "sum_", "mean_", "saturated_", "total_")


def event_log(rows: DataFrame, rule: Rule, keys: tuple[str, ...] = ("chan",)) -> DataFrame:
    """The detector's events: ``kind`` (stim_on, stim_off or ad), ``i``, ``t`` and ``stim``. A discharge is told once for each stimulation."""
    found = written(stimulations(rows, rule, keys), "stimulations")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("on_i"))
    numbered = found.withColumn("stim", number)
    begin = numbered.select(*keys, F.lit("stim_on").alias("kind"), F.col("on_i").alias("i"), F.col("on").alias("t"), "stim")
    end = numbered.where("off_i is not null").select(*keys, F.lit("stim_off"), "off_i", "off", "stim")
    told = detector_rows(rows, found, rule, keys).where(F.col("look") & (F.col("votes") >= rule.history_least)).select(*keys, "stim", "i", "t")
    ads = first_per(told, (*keys, "stim"), ("i",)).select(*keys, F.lit("ad"), "i", "t", "stim")
    return begin.union(end).union(ads)


def first_stimulations(rows: DataFrame, rule: Rule, most: int, chunk_seconds: float, keys: tuple[str, ...] = ("chan",), read: list[int] | None = None) -> DataFrame:
    """The first ``most`` stimulations of each channel: ``event``, ``on``, ``off`` and ``dur_s``, searched chunk by chunk of time.

    Each chunk is searched on its own, and a stimulation that lasts ends with its chunk. Chunks
    are taken in waves of 1, 2, 4, ... for all channels at once; channels that have enough leave before
    the next wave (an anti-join), so nothing behind it is searched for them. ``read`` takes up the
    number of rows of each wave."""
    at = F.floor(F.col("t") / chunk_seconds)
    span = rows.agg(F.min(at).alias("first"), F.max(at).alias("last")).first()
    left, found, begin, width = rows, None, span["first"], 1
    schema = [*keys, "chunk"]
    while begin is not None and begin <= span["last"]:
        wave = left.where(at.between(begin, begin + width - 1)).withColumn("chunk", at)
        order = Window.partitionBy(*schema).orderBy("i")
        chunked = wave.withColumn("i", F.row_number().over(order) - 1)
        ends = chunked.groupBy(*schema).agg(F.max("t").alias("end"), F.count("*").alias("n"))
        if read is not None:
            read.append(ends.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        new = stimulations(chunked, rule, tuple(schema)).join(ends, schema).select(*keys, "on", F.coalesce("off", "end").alias("off"))
        found = written(new if found is None else found.unionByName(new), "stimulation-waves")
        done = found.groupBy(*keys).count().where(F.col("count") >= most).select(*keys)
        left = rows.join(done, list(keys), "left_anti")
        begin, width = begin + width, 2 * width
    if found is None:
        return rows.select(*keys, F.lit(0).alias("event"), F.col("t").alias("on"), F.col("t").alias("off"), F.col("t").alias("dur_s")).limit(0)
    event = F.row_number().over(Window.partitionBy(*keys).orderBy("on"))
    return found.withColumn("event", event).where(F.col("event") <= most).select(*keys, "event", "on", "off", (F.col("off") - F.col("on")).alias("dur_s"))
