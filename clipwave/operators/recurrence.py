"""Linear recurrences over whole channels, as scans of affine maps in levels.

A one-pole recurrence v(i) = p v(i - 1) + u(i) is a chain of affine maps. Composing them is
associative, so a channel is cut into blocks of samples: within a block the recurrence runs
from silence, as a running sum of u(k) p^-k (a window over the block, linear work); what a
block hands on, its last value, is the input of the same recurrence over blocks, with p^block
for p; and what a block is given is added to each of its samples with p^(k + 1). Levels end
where p^block is under ``SILENT``, since a block is then only given what its predecessor
holds. A channel is thus dealt to tasks by block, however long it is.

Poles are complex: a filter of any order is the sum of one-pole recurrences (its parallel
form), all of which share the one window over the block. Sums are scaled by the block, so
they are as exact as the recurrence step by step.

``index`` counts a channel's samples up by one, from any start. Null samples count as 0.
"""

from __future__ import annotations

import cmath
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dsp import parallel_form

BLOCK = 256
#: Less than this of a state is not carried on.
SILENT = 1e-30
#: Powers of a pole stay over this within a block.
LEAST_POWER = 1e-250


def block_size(poles: list[complex], most: int) -> int:
    return max(1, min(most, *(int(math.log(LEAST_POWER) / math.log(abs(p))) for p in poles)))


def power(p: complex, k: Column) -> tuple[Column, Column]:
    """p^k: real and imaginary part."""
    size, angle = F.exp(F.lit(math.log(abs(p))) * k), cmath.phase(p)
    if angle == 0:
        return size, F.lit(0.0)
    return size * F.cos(F.lit(angle) * k), size * F.sin(F.lit(angle) * k)


def times(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def one_pole(rows: DataFrame, poles: list[complex], keys: tuple[str, ...], index: str, inputs: list[tuple[Column, Column | None]], block: int = BLOCK, level: int = 0) -> DataFrame:
    """``rows`` with ``re<n>`` and ``im<n>``, the recurrence of the n-th pole. ``inputs``: real and imaginary part of u for each pole; None is 0.

    A real pole with a real input has no ``im<n>``."""
    size = block_size(poles, block)
    rows = rows.withColumns({"blk_": F.floor(F.col(index) / size), "k_": F.pmod(F.col(index), F.lit(size))})
    so_far = Window.partitionBy(*keys, "blk_").orderBy("k_").rowsBetween(Window.unboundedPreceding, 0)
    given = f"in{level}_"
    k, local, plain = F.col("k_").cast("double"), {}, [p.imag == 0 and u[1] is None for p, u in zip(poles, inputs, strict=True)]
    for n, (p, (re, im)) in enumerate(zip(poles, inputs, strict=True)):
        back = power(1 / p, k)
        if plain[n]:
            local[f"re{n}"] = F.sum(re * back[0]).over(so_far) * power(p, k)[0]
            continue
        u = times((re, F.lit(0.0) if im is None else im), back)
        local[f"re{n}"], local[f"im{n}"] = times(tuple(F.sum(x).over(so_far) for x in u), power(p, k))
    rows = rows.withColumns(local)
    handed = rows.where(F.col("k_") == size - 1).select(*keys, (F.col("blk_") + 1).alias("blk_"), *(F.col(c).alias(f"{given}{c}") for c in local))
    deep = [n for n, p in enumerate(poles) if abs(p) ** size >= SILENT]
    if deep:
        handed_on = [(F.col(f"{given}re{n}"), None if plain[n] else F.col(f"{given}im{n}")) for n in deep]
        handed = one_pole(handed.withColumnRenamed("blk_", "at_"), [poles[n] ** size for n in deep], keys, "at_", handed_on, max(block, BLOCK), level + 1)
        states = {f"{part}{n}": f"{part}{d}" for d, n in enumerate(deep) for part in (["re"] if plain[n] else ["re", "im"])}
        handed = handed.select(*keys, F.col("at_").alias("blk_"), *(F.col(states.get(c, f"{given}{c}")).alias(f"{given}{c}") for c in local))
    rows = rows.join(handed, [*keys, "blk_"], "left")
    out = {}
    for n, p in enumerate(poles):
        state = tuple(F.coalesce(f"{given}{part}{n}", F.lit(0.0)) if f"{part}{n}" in local else F.lit(0.0) for part in ("re", "im"))
        re, im = times(state, power(p, k + 1))
        out[f"re{n}"] = F.col(f"re{n}") + re
        if not plain[n]:
            out[f"im{n}"] = F.col(f"im{n}") + im
    return rows.withColumns(out).drop("blk_", "k_", *(f"{given}{c}" for c in local))


def leaky_mean(rows: DataFrame, alpha: float, keys: tuple[str, ...], index: str, value: str, block: int = BLOCK) -> DataFrame:
    """``mean``: a one-pole leaky mean that begins at 0; ``high``: the samples less it."""
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    out = one_pole(rows, [complex(alpha)], keys, index, [(x, None)], block)
    return out.withColumn("mean", (1 - alpha) * F.col("re0")).withColumn("high", F.col(value) - F.col("mean")).drop("re0")


def decaying(rows: DataFrame, decay: float, keys: tuple[str, ...], index: str, value: str, block: int = BLOCK) -> DataFrame:
    """``buffer``: what is left of the values before, ``decay`` of it from each to the next, and the value itself."""
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    return one_pole(rows, [complex(decay)], keys, index, [(x, None)], block).withColumnRenamed("re0", "buffer")


def decaying_energy(rows: DataFrame, keys: tuple[str, ...], window: str, place: str, value: str, decay: float = 0.3, block: int = BLOCK) -> DataFrame:
    """``energy`` of each window's buffer: at each ``place`` in the window, what decays from window to window and the window's sample there."""
    held = decaying(rows, decay, (*keys, place), window, value, block)
    return held.groupBy(*keys, window).agg(F.sum(F.col("buffer") * F.col("buffer")).alias("energy"))


def filtered(rows: DataFrame, sections, keys: tuple[str, ...], index: str, value: str, out: str = "filtered", block: int = BLOCK) -> DataFrame:  # noqa: ANN001
    """Causal filtering from silence by second-order sections (``functions.dsp.butter_band``), all of them in one scan."""
    direct, poles, weights = parallel_form(sections)
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    scanned = one_pole(rows, poles, keys, index, [(x, None)] * len(poles), block)
    y = direct * x
    for n, (p, r) in enumerate(zip(poles, weights, strict=True)):
        y = y + (r.real * F.col(f"re{n}") if p.imag == 0 else 2 * (r.real * F.col(f"re{n}") - r.imag * F.col(f"im{n}")))
    return scanned.withColumn(out, y).drop(*(f"{part}{n}" for n in range(len(poles)) for part in ("re", "im")))


def totals(rows: DataFrame, value: Column, keys: tuple[str, ...], index: str, out: str, block: int = 4096) -> DataFrame:
    """``out``: the running total of ``value`` in each channel, in two levels (within blocks, over blocks)."""
    rows = rows.withColumn("blk_", F.floor(F.col(index) / block)).withColumn("v_", value)
    inside = Window.partitionBy(*keys, "blk_").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("blk_").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "blk_").agg(F.sum("v_").alias("sum_")).withColumn("sum_", F.sum("sum_").over(before))
    return rows.join(sums, [*keys, "blk_"]).withColumn(out, F.coalesce("sum_", F.lit(0)) + F.sum("v_").over(inside)).drop("blk_", "v_", "sum_")


def reflected(rows: DataFrame, less: Column, more: Column, keys: tuple[str, ...], index: str, out: str = "counter", block: int = 4096) -> DataFrame:
    """A counter that in each row first loses ``less``, but not below 0, and then gains ``more``.

    A walk S of gains and losses that is reflected at 0 is S less the least that S has been before
    a gain, if that is negative: two running totals, each in two levels."""
    rows = totals(rows.withColumns({"less_": less, "more_": more}), F.col("more_") - F.col("less_"), keys, index, "walk_", block)
    rows = rows.withColumn("low_", F.col("walk_") - F.col("more_")).withColumn("blk_", F.floor(F.col(index) / block))
    inside = Window.partitionBy(*keys, "blk_").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("blk_").rowsBetween(Window.unboundedPreceding, -1)
    least = rows.groupBy(*keys, "blk_").agg(F.min("low_").alias("least_")).withColumn("least_", F.min("least_").over(before))
    low = F.least(F.lit(0), F.col("least_"), F.min("low_").over(inside))  # least() skips nulls
    return rows.join(least, [*keys, "blk_"]).withColumn(out, F.col("walk_") - low).drop("blk_", "less_", "more_", "walk_", "low_", "least_")


def bad_counter(windows: DataFrame, over: str, keys: tuple[str, ...], index: str, every: int = 100, less: int = 5, block: int = 4096) -> DataFrame:
    """``counter`` of samples over the limit (``over``: how many in each window), which every ``every``-th window lowers by ``less`` first. ``index`` counts windows from 0."""
    falls = F.when((F.col(index) + 1) % every == 0, F.lit(less)).otherwise(F.lit(0))
    return reflected(windows, falls, F.coalesce(F.col(over), F.lit(0)), keys, index, "counter", block)
