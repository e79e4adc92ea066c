"""The detector as a stream: a state for each channel, which rows enter in order of time.

Channels are dealt by hash into buckets, and a bucket is what Spark keeps a state for: each call
between Spark and Python costs about a millisecond, so calls go by bucket and batch, not by channel. A replay has
as many buckets as its rows ask for, so a bucket doesn't grow with the input.

Rows of a bucket wait in a list until the watermark has passed them, so blocks may come in any
order within the watermark's delay; an event-time timer for the latest row of a bucket's batch hands
them to their channels' states in order. What is carried for a channel is bounded by the rule's numbers of rows: votes,
powers of off windows and history, and times of the latest onset, end and saturation.

A row that comes twice counts once. A row behind the watermark is late and not used (Spark drops it, and counts it in the query's
progress). A block that is lost isn't waited for: the rows that came count on. Rows of no channel (null) only move the
watermark, as in the batch plan they join nothing. A restart from the
checkpoint goes on with the state and the waiting rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.stimulation import Rule
from ..sources.shared import new_path

EVENT = "chan long, kind string, i long, t double, stim int"
STATE = "is_on boolean, votes array<boolean>, last_on double, ended double, stim int, told boolean, quiet array<double>, base double, saturated double, history array<boolean>, i long"
#: What a row is and how rows are ordered: by channel, then in time.
COLUMNS = ("chan", "at", "event_id", "t", "power")
#: Buckets of channels of a stream, unless told.
BUCKETS = 1024
#: About how many rows a replay has for each of its buckets.
BUCKET_ROWS = 8192
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(rule: Rule) -> dict:
    return {"is_on": False, "votes": [], "last_on": None, "ended": None, "stim": 0, "told": False, "quiet": [0.0] * rule.baseline_rows, "base": None, "saturated": None, "history": [], "i": 0}


def advance(s: dict, t: float, power: float, rule: Rule) -> list[str]:
    """One window of a channel: the state changes, the kinds of its events come back."""
    out: list[str] = []
    was_on = s["is_on"]
    look = not was_on and s["ended"] is not None and t <= s["ended"] + rule.look_seconds
    if was_on:
        if power < rule.off:
            s |= {"is_on": False, "ended": t}
            out.append("stim_off")
    else:
        s["votes"] = [*s["votes"], power > rule.on][-rule.vote_rows :]
        if sum(s["votes"]) >= rule.vote_least and (s["last_on"] is None or t > s["last_on"] + rule.separation_seconds):
            s |= {"is_on": True, "votes": [], "last_on": t, "stim": s["stim"] + 1, "told": False, "base": sum(s["quiet"][: rule.baseline_kept]) / rule.baseline_kept}
            out.append("stim_on")
        s["quiet"] = [*s["quiet"][1:], power]
    base, ratio = s["base"], None
    if (was_on or look) and base is not None and (base or power):
        ratio = power / base if base else float("inf")
        if ratio > rule.saturation:
            s["saturated"] = t
    fit = ratio is not None and rule.ratio < ratio < rule.saturation and not (s["saturated"] is not None and t - s["saturated"] < rule.cool_seconds)
    s["history"] = [*s["history"], fit][-rule.history_rows :] if look else []
    if look and not s["told"] and sum(s["history"]) >= rule.history_least:
        s["told"] = True
        out.append("ad")
    s["i"] += 1
    return out


class ChannelDetector(StatefulProcessor):
    """The detector for the channels of one bucket."""

    def __init__(self, rule: Rule) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: The states of all channels of the bucket in one value: read and written by one call for each batch.
        self.states = handle.getValueState("states", f"channels array<struct<chan: long, {STATE.replace(' ', ': ').replace(',:', ',')}>>")
        #: What came in one batch, as one entry: few entries, as each costs a call.
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} array<{'double' if c in ('t', 'power') else 'long'}>" for c in COLUMNS))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        came = [f for f in rows if len(f)]
        if came and not pd.isna(key[0]):  # rows of no channel only move the watermark
            came = {c: np.concatenate([f[c].to_numpy(np.float64 if c in ("t", "power") else np.int64) for f in came]) for c in COLUMNS}
            self.hold(came)
            self.handle.registerTimer(int(came["at"].max()) // 1000 + 1)
        return iter([])

    def hold(self, rows: dict[str, np.ndarray]) -> None:
        self.waiting.appendValue(tuple(rows[c].tolist() for c in COLUMNS))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get())
        rows = {c: np.concatenate([np.array(h[k], dtype=np.float64 if c in ("t", "power") else np.int64) for h in held]) for k, c in enumerate(COLUMNS)} if held else {}
        if not held or not (rows["at"] < passed).any():
            return
        self.waiting.clear()
        later = rows["at"] >= passed
        if later.any():
            self.hold({c: v[later] for c, v in rows.items()})
        due = np.lexsort([rows[c] for c in reversed(COLUMNS)])
        due = due[~later[due]]
        rows = {c: v[due] for c, v in rows.items()}
        again = np.logical_and.reduce([v[1:] == v[:-1] for v in rows.values()])
        once = np.concatenate([[True], ~again])
        names = [part.split()[0] for part in STATE.replace("array<", "").split(", ")]
        states = {x[0]: tuple(x[1:]) for x in self.states.get()[0]} if self.states.exists() else {}
        out, chan, s = [], None, {}
        for c, t, power in zip(*(rows[c][once].tolist() for c in ("chan", "t", "power")), strict=True):
            if c != chan:
                if chan is not None:
                    states[chan] = tuple(s[n] for n in names)
                chan, s = c, dict(zip(names, states[c], strict=True)) if c in states else start(self.rule)
            i = s["i"]
            out += [(c, kind, i, t, s["stim"]) for kind in advance(s, t, power, self.rule)]
        states[chan] = tuple(s[n] for n in names)
        self.states.update(([(c, *x) for c, x in states.items()],))
        yield pd.DataFrame(out, columns=["chan", "kind", "i", "t", "stim"])

    def close(self) -> None:
        pass


def detect(stream: DataFrame, rule: Rule, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Events of a stream of windows (``chan``, ``event_id``, ``ts``, ``t``, ``power``); append mode. ``buckets`` stays what it is for a checkpoint."""
    at = stream.withWatermark("ts", delay).withColumns({"at": F.unix_micros("ts"), "power": F.coalesce("power", F.lit(0.0))})
    bucket = F.when(F.col("chan").isNotNull(), F.pmod(F.xxhash64("chan"), F.lit(buckets)))
    return at.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(ChannelDetector(rule), EVENT, "append", "EventTime")


def run(source: str, schema, rule: Rule, log: str, checkpoint: str, spark, delay: str = "0 seconds", files: int = 1, buckets: int = BUCKETS) -> None:  # noqa: ANN001
    """Take what is new in the folder ``source``, ``files`` files at a time; append events to ``log``."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        detect(stream, rule, delay, buckets).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def replay(rows: DataFrame, rule: Rule, spans: int = 4) -> DataFrame:
    """The log of stored windows, replayed as files of ``spans`` spans of time. Files of a span come in any order, so the watermark is a span late; a last row of no channel moves it over the end."""
    spark = rows.sparkSession
    source, log, checkpoint = (new_path(spark, n) for n in ("windows", "detector-log", "detector-state"))
    ends = rows.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).first()
    if ends["first"] is None:
        return spark.createDataFrame([], EVENT)
    span = (ends["last"] - ends["first"]) / spans
    tasks = max(1, spark.sparkContext.defaultParallelism)
    for k in range(spans):
        after, until = F.col("ts") >= F.lit(ends["first"] + k * span), F.col("ts") < F.lit(ends["first"] + (k + 1) * span)
        rows.where(after & until if k < spans - 1 else after).repartition(tasks).write.mode("append").parquet(source)
    late = int(span.total_seconds()) + 1
    closing = rows.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("chan"), F.lit(0).cast("long").alias("event_id"), (F.col("ts") + F.expr(f"interval {2 * late} seconds")).alias("ts"), F.lit(0.0).alias("t"), F.lit(0.0).alias("power"))
    closing.select(rows.columns).write.mode("append").parquet(source)
    run(source, rows.schema, rule, log, checkpoint, spark, f"{late} seconds", tasks, max(4 * tasks, ends["n"] // BUCKET_ROWS))
    return spark.read.schema(EVENT).parquet(log)
