"""Spark jobs around the streaming detector: stim search by pieces, replay in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators.patterns import merge_events
from ..plans.clips import lists
from ..sources.shared import new_path
from .detectors import Detector, find_stimulations

EVENT = "clip string, kind string, channel string, t double"
#: Blocks of a clip that wait for an earlier one; with more of them, that one is given up and counts as missing samples.
MOST_WAITING = 64
#: A clip of which nothing came for so long is over.
TIMEOUT_MS = 60_000


def matrix(table: pa.Table) -> tuple[list[str], np.ndarray]:
    """Labels and samples x channels of one piece, whose rows are channels."""
    labels, samples = table.column("label").to_pylist(), lists(table.column("samples"))
    order = np.argsort(table.column("chan").to_numpy(), kind="stable")
    return [labels[i] for i in order], np.stack([samples[i] for i in order], axis=1)


def first_of(table: pa.Table, name: str):  # noqa: ANN201
    return table.column(name)[0].as_py()


def session_stimulations(segments: DataFrame, gap: float = 3.0) -> DataFrame:
    """Stimulations of each recording. Each stretch of time is searched on its own, so they run in parallel; events cut by a boundary are merged."""

    def work(table: pa.Table) -> pa.Table:
        labels, x = matrix(table)
        clip, rate, first = (first_of(table, c) for c in ("clip", "rate", "first_sample"))
        found = find_stimulations(x, labels, rate, first / rate, (first + len(x)) / rate)
        cols = list(zip(*[(clip, "-".join(sorted((labels[a], labels[b]))), on, off, int(on * 1e6)) for a, b, on, off in found], strict=True)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["clip", "pair", "on", "off", "event"])

    found = segments.groupBy("clip", "first_sample").applyInArrow(work, "clip string, pair string, on double, off double, event long")
    return merge_events(found, gap, ("clip",), "pair")


def blocks_of(table: pa.Table) -> Iterator[np.ndarray]:
    """Blocks (samples x channels) of one clip in order."""
    column, n = table.column("block").combine_chunks(), len(first_of(table, "labels"))
    ends = column.offsets.to_numpy()
    channels = column.values
    flat, inner = channels.values.to_numpy(zero_copy_only=False).astype(np.float64), channels.offsets.to_numpy()
    for i in np.argsort(table.column("seq").to_numpy(), kind="stable"):
        a, b = inner[ends[i]], inner[ends[i + 1]]
        yield flat[a:b].reshape(n, -1).T


def events_table(found: list[tuple]) -> pa.Table:
    cols = list(zip(*found, strict=True)) or [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)], names=["clip", "kind", "channel", "t"])


def replay(blocks: DataFrame) -> DataFrame:
    """Batch twin of the stream: each clip's blocks in order through one detector."""

    def work(table: pa.Table) -> pa.Table:
        d, clip = Detector(first_of(table, "labels"), first_of(table, "rate")), first_of(table, "clip")
        return events_table([(clip, *e) for b in blocks_of(table) for e in d.feed(b)])

    return blocks.groupBy("clip").applyInArrow(work, EVENT)


def replay_by_size(segments: DataFrame, sizes_ms: tuple[int, ...] = (100, 250, 500, 1000)) -> DataFrame:
    """The event logs of whole clips, replayed in blocks of each size: ``block_ms`` and EVENT. ``segments``: channels of clips.

    One task for each clip and size; the clip's samples are joined once and cut inside it."""

    def work(table: pa.Table) -> pa.Table:
        clip, rate, ms = (first_of(table, c) for c in ("clip", "rate", "block_ms"))
        pieces: dict[int, list] = {}
        for chan, first, label, x in zip(*(table.column(c).to_pylist() for c in ("chan", "first_sample", "label")), lists(table.column("samples")), strict=True):
            pieces.setdefault(chan, []).append((first, label, x))
        x = np.stack([np.concatenate([x for *_, x in sorted(p, key=lambda q: q[0])]) for _, p in sorted(pieces.items())], axis=1)
        d, size = Detector([p[0][1] for _, p in sorted(pieces.items())], rate), max(1, int(np.floor(ms / 1000 * rate + 0.5)))
        out = events_table([(clip, *e) for k in range(0, len(x), size) for e in d.feed(x[k : k + size])])
        return out.append_column("block_ms", pa.array([ms] * out.num_rows, pa.int32()))

    sized = segments.withColumn("block_ms", F.explode(F.array(*(F.lit(m) for m in sizes_ms))))
    return sized.groupBy("clip", "block_ms").applyInArrow(work, f"{EVENT}, block_ms int")


def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, timeout: bool = False) -> Iterator[pd.DataFrame]:
    """One micro-batch of one clip. Blocks that come before their turn wait in the state; ones
    that were seen are dropped. When MOST_WAITING wait, or nothing comes any more, a block that
    is lost counts as missing samples; a clip that timed out leaves no state."""
    detector, turn, early = None, 0, {}
    if state.exists:
        raw, turn, waiting = state.get
        detector = Detector.from_bytes(bytes(raw))
        early = Detector.from_bytes(bytes(waiting))
    for f in frames:
        for r in f.itertuples():
            if r.seq >= turn:
                early[r.seq] = np.array([np.asarray(x, dtype=np.float64) for x in r.block]).T
            if detector is None:
                detector = Detector(list(r.labels), r.rate)
    out = []
    while early and (turn in early or len(early) > MOST_WAITING or state.hasTimedOut):
        block = early.pop(turn, None)
        if block is None:
            block = np.full_like(early[min(early)], np.nan)
        out += [(key[0], *e) for e in detector.feed(block)]
        turn += 1
    if state.hasTimedOut:
        state.remove()
    else:
        import pickle

        state.update((detector.to_bytes(), turn, pickle.dumps(early)))
        if timeout:
            state.setTimeoutDuration(TIMEOUT_MS)
    yield pd.DataFrame(out, columns=["clip", "kind", "channel", "t"])


def detect_stream(blocks: DataFrame, timeout: bool = True) -> DataFrame:
    """Events of a stream of blocks (``clip``, ``rate``, ``labels``, ``seq``, ``block``); append mode. A query with timeouts never ends by itself."""
    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    return blocks.groupBy("clip").applyInPandasWithState(partial(step, timeout=timeout), EVENT, "detector binary, turn long, waiting binary", "append", kind)


def run_stream(blocks: DataFrame, files: int = 3) -> DataFrame:
    """Replay stored blocks as a stream of files and return the event log that it wrote."""
    spark = blocks.sparkSession
    src, log, checkpoint = (new_path(spark, n) for n in ("blocks", "event-log", "stream-state"))
    blocks.repartition(files, "seq").write.parquet(src)
    stream = spark.readStream.schema(blocks.schema).option("maxFilesPerTrigger", 1).parquet(src)
    detect_stream(stream, timeout=False).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(EVENT).parquet(log)


def event_table(log: DataFrame) -> DataFrame:
    """Stimulation rows with their ends (null while open) and discharges, from an event log. An end belongs to the last onset before it: one sort of both, no join."""
    later = Window.partitionBy("clip", "channel").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.min(F.when(F.col("kind") == "stim_off", F.col("t"))).over(later)
    stim = log.where("kind in ('stim_on', 'stim_off')").withColumn("off_time", ends).where("kind = 'stim_on'")
    stim = stim.select("clip", F.lit("stim").alias("kind"), "channel", F.col("t").alias("on_time"), "off_time")
    ad = log.where("kind = 'ad'").select("clip", F.lit("AD").alias("kind"), "channel", F.col("t").alias("on_time"), F.lit(None).cast("double").alias("off_time"))
    return stim.union(ad)
