"""Window operators over samples: rows of (channel, sample number, value) or arrays.

Windows tumble by counts of samples. A function that takes ``chan`` and ``win`` column names
works on any partitioning of the samples by channel; nothing is ordered across channels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import EPS, true_if


def numbered(rows: DataFrame, chan: str, *order: str) -> DataFrame:
    """``i``: the sample's number in its channel, from 0."""
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(chan).orderBy(*order)) - 1)


def window_samples(seconds: float, rate: float) -> int:
    """Samples of a window: seconds times rate, half away from zero."""
    return int(seconds * rate + 0.5)


def tumble(rows: DataFrame, size: int, chan: str = "chan", last: str = "complete") -> DataFrame:
    """``win``: the tumbling window. Incomplete windows go; ``last="drop"`` drops the last complete one too."""
    n = F.count("*").over(Window.partitionBy(chan))
    most = n if last == "complete" else n - 1
    return rows.withColumn("n_", most).withColumn("win", F.floor(F.col("i") / size)).where((F.col("win") + 1) * size <= F.col("n_")).drop("n_")


def fill_demean(rows: DataFrame, chan: str = "chan", win: str = "win", value: str = "x") -> DataFrame:
    """Missing samples become their window's mean, then the mean goes; a window without any sample is 0."""
    mean = F.coalesce(F.avg(value).over(Window.partitionBy(chan, win)), F.lit(0.0))
    return rows.withColumn("demeaned", F.coalesce(F.col(value), mean) - mean)


def line_length(rows: DataFrame, chan: str = "chan", win: str = "win", order: str = "i", value: str = "x") -> DataFrame:
    """Sum of absolute steps inside each window."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(chan, win).orderBy(order)))
    return rows.withColumn("step", step).groupBy(chan, win).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("ll"))


def line_length_of(samples: Column) -> Column:
    """Line length of an array of samples."""
    pairs = F.zip_with(F.slice(samples, 1, F.size(samples) - 1), F.slice(samples, 2, F.size(samples) - 1), lambda a, b: F.abs(b - a))
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


def energy_of(samples: Column) -> Column:
    return F.aggregate(F.transform(samples, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)


def let(value: Column, then) -> Column:  # noqa: ANN001
    """``then`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def bin_power(samples: Column, k: Column, n: Column) -> Column:
    """Squared size of the k-th bin of the discrete Fourier transform of ``n`` samples, by Goertzel's recurrence."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))

    def of(turn: Column) -> Column:
        step = lambda s, x: F.struct((x + turn * s["a"] - s["b"]).alias("a"), s["a"].alias("b"))
        return F.aggregate(samples, start, step, lambda s: s["a"] * s["a"] + s["b"] * s["b"] - turn * s["a"] * s["b"])

    return let(2 * F.cos(F.lit(2 * math.pi) * k / n), of)


def band_energy_of(samples: Column, rate: float, low: float, high: float) -> Column:
    """Power of an array of samples in a band: one-sided Hamming periodogram, bins from ``low`` to ``high`` times their width. Null samples count as 0; null for fewer than two samples."""
    n = F.size(samples)
    weights = F.transform(F.sequence(F.lit(0), n - 1), lambda i: 0.54 - 0.46 * F.cos(F.lit(2 * math.pi) * i / (n - 1)))
    first = F.ceil(F.lit(float(low)) * n / rate - 1e-9).cast("int")
    last = F.least(F.floor(F.lit(float(high)) * n / rate + 1e-9), F.floor(n / 2)).cast("int")
    sided = lambda k: F.when((k == 0) | (2 * k == n), 1.0).otherwise(2.0)
    bins = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    def of(w: Column) -> Column:
        weighted = F.zip_with(samples, w, lambda x, v: F.coalesce(x.cast("double"), F.lit(0.0)) * v)
        total = let(weighted, lambda x: F.aggregate(bins, F.lit(0.0), lambda a, k: a + sided(k) * bin_power(x, k, n)))
        return total / (F.aggregate(w, F.lit(0.0), lambda a, v: a + v * v) * n)

    return F.when(n > 1, let(weights, of))


# Baseline statistics and vetoes of the clip detector


def robust_baseline(ll: DataFrame, chan: str = "chan", value: str = "ll", trim: float = 0.2, keys: tuple[str, ...] = ()) -> DataFrame:
    """Median and MAD of each channel's lowest windows: the upper ``trim`` of them is left out."""
    w = Window.partitionBy(*keys, chan)
    ranked = ll.withColumns({"r_": F.row_number().over(w.orderBy(value)), "n_": F.count("*").over(w)})
    kept = ranked.where(F.col("r_") <= F.greatest(F.lit(1), F.floor(F.col("n_") * (1 - trim) + 1e-9))).withColumn("med_", F.median(value).over(w))
    # Ranks, medians and deviations all by one shuffle on the channel.
    return kept.groupBy(*keys, chan).agg(F.first("med_").alias("med"), F.count("*").alias("n_baseline"), F.median(F.abs(F.col(value) - F.col("med_"))).alias("mad"))


def z_scores(ll: DataFrame, baseline: DataFrame, clip: str = "clip", chan: str = "chan", value: str = "ll", floor: float = 0.25) -> DataFrame:
    """Line lengths in units of the baseline: 1.4826 MAD, but at least ``floor`` of the median of the clip's channel medians."""
    based = baseline.withColumn("gmed", F.median("med").over(Window.partitionBy(clip)))
    scale = F.greatest(1.4826 * F.col("mad"), floor * F.col("gmed")) + EPS
    return ll.join(based, [clip, chan]).withColumn("z", (F.col(value) - F.col("med")) / scale)


def hf_veto(hf: Column, inband: Column, z_hf: Column, spare: float = 0.2, z: float = 5.0, ratio: float = 1.0) -> Column:
    """High-frequency artifact: a fair share of the energy, and either far above baseline or most of it."""
    share = hf / (inband + EPS)
    return true_if((share >= spare) & ((z_hf >= z) | (share > ratio)))


def line_noise_veto(line: Column, inband: Column, most: float = 0.5) -> Column:
    return true_if(line / (inband + EPS) > most)


def next_stim_veto(t: Column, next_on: Column, margin: float = 0.5) -> Column:
    """Windows that begin within ``margin`` of the next stimulation, or after it."""
    return true_if(t >= next_on - margin)


def saturation_cut(windows: DataFrame, over: Column, keys: tuple[str, ...], order: str) -> DataFrame:
    """``cut``: true from the first of two consecutive windows for which ``over`` holds on."""
    w = Window.partitionBy(*keys).orderBy(order)
    twice = true_if(over) & true_if(F.lead(over).over(w))
    first = F.min(F.when(F.col("twice_"), F.col(order))).over(Window.partitionBy(*keys))
    return windows.withColumn("twice_", twice).withColumn("cut", true_if(F.col(order) >= first)).drop("twice_")
