"""Token counts from an exact length histogram.

Documents are encoded once and aggregated by their number of tokens. Suffix sums over the
histogram then answer every question about context limits without going back to the
documents: how many documents reach a length, how many tokens they have, what is left of
all tokens when each document is cut at a limit, and quantiles of the lengths.

The histogram has one row for each length that occurs. Suffix sums are taken in two
levels: lengths fall into blocks of ``BLOCK``; blocks are summed first, so a task sorts
the lengths of one block or the list of blocks, never all rows.

Edge cases: a null text has length 0, as an empty one. An empty table gives an empty
histogram; its totals are 0 and its quantiles null. Repeated rows count as often as they
occur. Clashing columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from .common import map_slices, materialize

BLOCK = 256


def lengths(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``n_tokens`` of every text: the number of tokens, nothing else."""
    path = path or bpe.default_path()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        encoder = bpe.load(path)
        return pa.RecordBatch.from_arrays([pa.array([len(encoder.encode(t)) for t in part.column(text).to_pylist()], pa.int64())], names=["n_tokens"])

    return map_slices(docs.select(text), work, "n_tokens long", text, "bpe")


def histogram(counted: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row for each length: ``n_docs``, suffix sums ``docs_from`` and ``tokens_from``
    (documents at least as long, and their tokens), ``docs_over`` (longer ones) and
    ``tokens_cut`` (what is left of all tokens if each document is cut at that length)."""
    # Written once: both levels of sums read it, and documents aren't encoded again.
    bars = materialize(counted.groupBy(F.col(length).alias("n_tokens")).agg(F.count("*").alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "bars")
    blocks = bars.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    # The blocks: at most (longest text / BLOCK) rows.
    down = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    above = blocks.select("block", F.coalesce(F.sum("d").over(down), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(down), F.lit(0)).alias("t_above"), F.sum("t").over(Window.partitionBy(F.lit(0))).alias("t_all"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    summed = bars.withColumns({"d_in": F.sum("n_docs").over(inside), "t_in": F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)})
    out = summed.join(above, "block")
    return out.select(
        "n_tokens",
        "n_docs",
        (F.col("d_in") + F.col("d_above")).alias("docs_from"),
        (F.col("t_in") + F.col("t_above")).alias("tokens_from"),
        (F.col("d_in") + F.col("d_above") - F.col("n_docs")).alias("docs_over"),
        (F.col("t_all") - F.col("t_in") - F.col("t_above") + F.col("n_tokens") * (F.col("d_in") + F.col("d_above"))).alias("tokens_cut"),
    )


def for_limits(bars: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: ``n_docs``, ``total_tokens``, ``docs_over``, ``tokens_cut``; any limit, whether a length or not.

    Each is read off the suffix sums of the shortest length over the limit."""
    sums = F.struct("docs_from", "tokens_from")
    first = [F.min_by(sums, F.when(F.col("n_tokens") > n, F.col("n_tokens"))).alias(f"x{i}") for i, n in enumerate(limits)]
    one = bars.agg(F.coalesce(F.max("docs_from"), F.lit(0)).alias("n_docs"), F.coalesce(F.max("tokens_from"), F.lit(0)).alias("total_tokens"), *first)
    over = lambda i, c: F.coalesce(F.col(f"x{i}.{c}"), F.lit(0))
    cut = lambda i, n: F.col("total_tokens") - over(i, "tokens_from") + F.lit(n).cast("long") * over(i, "docs_from")
    each = F.array(*(F.struct(F.lit(n).cast("long").alias("limit"), over(i, "docs_from").alias("docs_over"), cut(i, n).alias("tokens_cut")) for i, n in enumerate(limits)))
    return one.select("n_docs", "total_tokens", F.explode(each).alias("x")).select("x.limit", "n_docs", "total_tokens", "x.docs_over", "x.tokens_cut")


def quantiles(bars: DataFrame, at: list[float]) -> DataFrame:
    """``q`` and ``n_tokens``: the shortest length that at least a share ``q`` of the documents doesn't exceed."""
    n = bars.agg(F.max("docs_from")).first()[0]
    if n is None:
        return bars.sparkSession.createDataFrame([(float(q), None) for q in at], "q double, n_tokens long")
    reached = [F.min(F.when(n - F.col("docs_over") >= math.ceil(q * n), F.col("n_tokens"))) for q in at]
    each = F.array(*(F.struct(F.lit(float(q)).alias("q"), r.alias("n_tokens")) for q, r in zip(at, reached, strict=True)))
    return bars.agg(each.alias("x")).select(F.explode("x").alias("x")).select("x.q", "x.n_tokens")


def brute_force(sizes: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """The histogram's rows, from the lengths one by one; for tests."""
    a = np.array(sizes, dtype=np.int64)
    return [(int(n), int((a == n).sum()), int((a >= n).sum()), int(a[a >= n].sum()), int((a > n).sum()), int(np.minimum(a, n).sum())) for n in np.unique(a)]
