"""Recordings as a Spark data source, and EDF files as a sink.

``clipwave_eeg`` is a Python data source: it plans one partition for each clip, group of
channels and stretch of time, as a range scan of a remote store would, and yields segments
``(clip, chan, label, rate, first_sample, samples)``. Here the store is a closed form (a
stimulation at 50 Hz on one pair; in odd clips a discharge on a neighbour after it), so
tests know what must be found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CONTACTS = 8
ON, OFF = 10.0, 12.0


def recording(clip: int, chans: range, first: int, count: int, rate: float) -> np.ndarray:
    """Samples x channels of contacts LA1 to LA8."""
    t = (first + np.arange(count)) / rate
    x = np.column_stack([20 * np.sin(2 * np.pi * 8 * t + k) for k in chans])
    stim, after = (t >= ON) & (t < OFF), (t >= OFF) & (t < OFF + 6)
    wave = 2e4 * np.sin(2 * np.pi * 50 * t) * stim
    for j, k in enumerate(chans):
        if k in (2, 3):
            x[:, j] += wave if k == 2 else -wave
        if clip % 2 and k == 5:
            x[:, j] += 400 * np.sign(np.sin(2 * np.pi * 5 * t)) * np.sin(2 * np.pi * 15 * t) * after
    return x


@dataclass
class Piece(InputPartition):
    clip: int
    chans: tuple[int, int]
    first: int
    count: int


class EegReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.clips, self.seconds, self.rate = int(options.get("clips", 4)), float(options.get("seconds", 30)), float(options.get("rate", 1000))
        self.piece = int(float(options.get("piece_seconds", 10)) * self.rate)

    def partitions(self) -> list[InputPartition]:
        total = int(self.seconds * self.rate)
        half = CONTACTS // 2
        return [Piece(c, g, s, min(self.piece, total - s)) for c in range(self.clips) for g in ((0, half), (half, CONTACTS)) for s in range(0, total, self.piece)]

    def read(self, part: Piece) -> Iterator[tuple]:
        x = recording(part.clip, range(*part.chans), part.first, part.count, self.rate)
        for j, k in enumerate(range(*part.chans)):
            yield (f"S_1_ev{part.clip:02d}_LA3-LA4", k, f"LA{k + 1}", self.rate, part.first, x[:, j].tolist())


class EegSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clipwave_eeg"

    def schema(self) -> str:
        return "clip string, chan int, label string, rate double, first_sample long, samples array<double>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return EegReader(self.options)


def read_eeg(spark: SparkSession, **options) -> DataFrame:  # noqa: ANN003
    spark.dataSource.register(EegSource)
    return spark.read.format("clipwave_eeg").options(**{k: str(v) for k, v in options.items()}).load()


def blocks(segments: DataFrame, samples: int) -> DataFrame:
    """Segments of single channels as blocks of all channels: ``clip``, ``labels``, ``rate``, ``seq`` and ``block`` (for each channel its samples).

    Arrays are cut, never exploded into samples, and dealt once by clip and block."""
    last = F.col("first_sample") + F.size("samples") - 1
    s = segments.where(F.size("samples") > 0).withColumn("seq", F.explode(F.sequence(F.floor(F.col("first_sample") / samples), F.floor(last / samples))))
    start = F.greatest(F.col("seq") * samples, F.col("first_sample"))
    stop = F.least((F.col("seq") + 1) * samples, last + 1)
    part = s.select("clip", "rate", "seq", "chan", "label", start.alias("start"), F.slice("samples", (start - F.col("first_sample") + 1).cast("int"), (stop - start).cast("int")).alias("x")).repartition("clip", "rate", "seq")
    one = part.groupBy("clip", "rate", "seq", "chan").agg(F.min("label").alias("label"), F.array_sort(F.collect_list(F.struct("start", "x"))).alias("p"))
    joined = one.select("clip", "rate", "seq", F.struct("chan", "label", F.flatten(F.transform("p", lambda v: v["x"])).alias("x")).alias("c"))
    every = joined.groupBy("clip", "rate", "seq").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return every.select("clip", "rate", "seq", F.col("c.label").alias("labels"), F.col("c.x").alias("block"))


def edf_labels(labels: list[str]) -> list[str]:
    """Labels of at most 16 printable ASCII characters, each once: another of the same gets a number."""
    out: list[str] = []
    for name in labels:
        plain = "".join(c if 32 <= ord(c) < 127 else "_" for c in name).strip()[:16] or "chan"
        unique, k = plain, 2
        while unique in out:
            tail = f"_{k}"
            unique, k = plain[: 16 - len(tail)] + tail, k + 1
        out.append(unique)
    return out


def edf_bytes(labels: list[str], rate: float, x: np.ndarray) -> bytes:
    """An EDF file of one data record: fixed-width header fields in ASCII, then 16-bit samples, channel after channel."""
    n, m = x.shape
    x = np.nan_to_num(x)
    low, high = np.floor(x.min(axis=0)), np.ceil(x.max(axis=0))
    high = np.where(high <= low, low + 1, high)
    low, high = np.clip(low, -9999999, 9999999), np.clip(high, -9999999, 9999999)
    text = lambda v, width: str(v)[:width].ljust(width)
    head = text(0, 8) + text("X X X X", 80) + text("Startdate X X X X", 80) + "01.01.85" + "00.00.00" + text(256 * (m + 1), 8) + text("", 44) + text(1, 8) + text(f"{n / rate:.8g}", 8) + text(m, 4)
    for values, width in ((edf_labels(labels), 16), ([""] * m, 80), (["uV"] * m, 8), ([f"{v:.0f}" for v in low], 8), ([f"{v:.0f}" for v in high], 8), ([-32768] * m, 8), ([32767] * m, 8), ([""] * m, 80), ([n] * m, 8), ([""] * m, 32)):
        head += "".join(text(v, width) for v in values)
    body = np.clip(np.floor((x - low) / (high - low) * 65535 - 32768 + 0.5), -32768, 32767).astype("<i2")
    return head.encode("ascii", "replace") + body.T.tobytes()


def to_edf(clips: DataFrame) -> DataFrame:
    """``clip`` and ``edf`` (binary): a file for each clip. Input: one row for each clip and channel (``clip``, ``chan``, ``label``, ``rate``, ``samples``)."""

    def work(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        from ..streaming.jobs import first_of, matrix

        labels, x = matrix(table)
        return pa.table({"clip": [first_of(table, "clip")], "edf": pa.array([edf_bytes(labels, first_of(table, "rate"), x)], pa.binary())})

    return clips.select("clip", "chan", "label", "rate", "samples").groupBy("clip").applyInArrow(work, "clip string, edf binary")
