"""Scoring detections against annotations: confusion, onset errors, ROC, thresholds, folds.

Scores are aggregated to one row for each value before anything is ordered, and running
totals over values are taken in two levels (ranges of values, then inside each), so no
single task orders all clips.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import true_if

RANGES = 64
#: Scores that are looked at together in one range: rows of counts for all groups.
CHUNK = 256


def confusion(rows: DataFrame, truth: Column, predicted: Column, by: tuple[str, ...] = (), empty: str = "null") -> DataFrame:
    """Counts and rates. ``empty``: rates over nothing are null (streaming report) or 0 (clip report)."""
    count = lambda c: F.sum(c.cast("long"))
    n = rows.groupBy(*by).agg(count(truth & predicted).alias("tp"), count(truth & ~predicted).alias("fn"), count(~truth & predicted).alias("fp"), count(~truth & ~predicted).alias("tn"))
    over = (lambda a, b: F.try_divide(a.cast("double"), b)) if empty == "null" else (lambda a, b: a / F.greatest(b, F.lit(1)))
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    return n.withColumns({"sens": over(tp, tp + fn), "spec": over(tn, tn + fp), "ppv": over(tp, tp + fp), "fpr": over(fp, fp + tn), "acc": over(tp + tn, tp + fn + fp + tn)})


def histogram(rows: DataFrame, label: Column, score: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each score: how many positive and negative clips have it. A missing run (minus infinity) counts as the least finite score less 1."""
    least = rows.where(score > float("-inf")).agg(F.min(score)).first()[0]
    held = F.when(score > float("-inf"), score).otherwise(F.lit((least or 0.0) - 1))
    return rows.groupBy(*by, held.alias("score")).agg(F.sum(label.cast("long")).alias("pos"), F.sum((~label).cast("long")).alias("neg"))


def range_of(hist: DataFrame) -> Column:
    """The range that a score falls into: at most RANGES of about equal numbers of rows."""
    cuts = sorted(set(hist.approxQuantile("score", [i / RANGES for i in range(1, RANGES)], 0.005)))
    return F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c <= F.col("score"))) if cuts else F.lit(0)


def totals_above(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``pos_above`` and ``neg_above``: clips with a higher score; ``pos_all`` and ``neg_all``."""
    h = hist.withColumn("bucket_", range_of(hist))
    before = Window.partitionBy(*by).orderBy(F.desc("bucket_")).rowsBetween(Window.unboundedPreceding, -1)
    sums = h.groupBy(*by, "bucket_").agg(F.sum("pos").alias("p_"), F.sum("neg").alias("n_"))
    whole = Window.partitionBy(*by)
    sums = sums.select(*by, "bucket_", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("p_", "n_")), F.sum("p_").over(whole).alias("pos_all"), F.sum("n_").over(whole).alias("neg_all"))
    inside = Window.partitionBy(*by, "bucket_").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    out = h.withColumns({"pi_": F.coalesce(F.sum("pos").over(inside), F.lit(0)), "ni_": F.coalesce(F.sum("neg").over(inside), F.lit(0))}).join(sums, [*by, "bucket_"])
    return out.withColumns({"pos_above": F.col("pi_") + F.col("p_0"), "neg_above": F.col("ni_") + F.col("n_0")}).drop("pi_", "ni_", "p_0", "n_0", "bucket_")


def candidates(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Thresholds (each score, and the least less 1; a clip is positive above it) with sensitivity and specificity."""
    t = totals_above(hist, by)
    rates = lambda p, n: (F.try_divide(p.cast("double"), F.col("pos_all")).alias("sens"), F.try_divide((F.col("neg_all") - n).cast("double"), F.col("neg_all")).alias("spec"))
    each = t.select(*by, F.col("score").alias("threshold"), *rates(F.col("pos_above"), F.col("neg_above")))
    lowest = t.groupBy(*by).agg((F.min("score") - 1).alias("threshold"), F.max("pos_all").alias("pos_all"), F.max("neg_all").alias("neg_all"))
    return each.union(lowest.select(*by, "threshold", *rates(F.col("pos_all"), F.col("neg_all"))))


def best_threshold(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The threshold with the most sens + spec - 1; the lowest on ties."""
    j = F.round(F.col("sens") + F.col("spec") - 1, 12)
    best = F.max_by(F.struct("threshold", "sens", "spec"), F.struct(j, -F.col("threshold")))
    return candidates(hist, by).where("sens is not null and spec is not null").groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def at_specificity(hist: DataFrame, least: float = 0.9) -> DataFrame:
    """The most sensitivity with a specificity of at least ``least``; the lowest threshold on ties. None: the top score, 0 and 1."""
    fit = F.struct("sens", -F.col("threshold"))
    rows = candidates(hist)
    best = F.max_by(F.struct("threshold", "sens", "spec"), F.when(F.col("spec") >= least, fit))
    none = F.struct(F.max("threshold").alias("threshold"), F.lit(0.0).alias("sens"), F.lit(1.0).alias("spec"))
    return rows.agg(F.coalesce(best, none).alias("b")).select("b.*")


def roc_auc(hist: DataFrame) -> DataFrame:
    """Chance that a positive clip scores above a negative one; ties count half. Null if a class is missing."""
    t = totals_above(hist)
    below = F.col("neg_all") - F.col("neg_above") - F.col("neg")
    won = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    return t.agg(F.try_divide(won, (F.max("pos_all") * F.max("neg_all")).cast("double")).alias("auc"))


def leave_one_out(rows: DataFrame, label: Column, score: Column, group: str, default: float) -> DataFrame:
    """For each group the threshold that the other groups choose; ``default`` where they lack a class.

    No fold is copied out: in each range of scores running counts of all groups are kept at
    once, and a fold's counts are the sums over all groups less its own. Groups are patients,
    so a row of counts for all of them is small."""
    hist = histogram(rows, label, score, (group,)).withColumnRenamed(group, "group_")
    ranged = hist.withColumn("range_", range_of(hist))
    part = ranged.groupBy("group_", "range_").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    whole = part.groupBy("group_").agg(F.collect_list(F.struct("range_", "p", "n")).alias("x"))  # at most RANGES for each group
    above = lambda c: F.aggregate(F.filter("x", lambda y: y["range_"] > F.col("range_")), F.lit(0).cast("long"), lambda a, y: a + y[c])
    all_of = lambda c: F.aggregate("x", F.lit(0).cast("long"), lambda a, y: a + y[c])
    base = whole.withColumn("range_", F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1)))).select(F.col("group_").alias("fold_"), F.col("range_").alias("at_"), above("p").alias("p0"), above("n").alias("n0"), all_of("p").alias("p_all"), all_of("n").alias("n_all"))
    kind = hist.schema["group_"].dataType.simpleString()

    def choose(table: pa.Table, before: pa.Table) -> pa.Table:
        """Each fold's best threshold among the scores of one range that other groups have."""
        names = before.column("fold_").to_pylist()
        place = {g: i for i, g in enumerate(names)}
        p0, n0, p_all, n_all = (before.column(c).to_numpy().astype(np.float64) for c in ("p0", "n0", "p_all", "n_all"))
        a, b = p_all.sum() - p_all, n_all.sum() - n_all
        score, owner = table.column("score").to_numpy(), np.array([place[g] for g in table.column("group_").to_pylist()], dtype=np.int64)
        counts = [table.column(c).to_numpy() for c in ("pos", "neg")]
        best, at = np.full(len(names), -np.inf), np.full(len(names), np.nan)
        values = np.unique(score)[::-1]
        for k in range(0, len(values), CHUNK):
            some = values[k : k + CHUNK]
            rows_ = np.flatnonzero((score <= some[0]) & (score >= some[-1]))
            line = np.searchsorted(-some, -score[rows_])
            own = np.zeros((2, len(some), len(names)))
            for c in (0, 1):
                np.add.at(own[c], (line, owner[rows_]), counts[c][rows_])
            mine = own.cumsum(axis=1) - own + np.stack([p0, n0])[:, None, :]  # with a higher score
            others = mine.sum(axis=2, keepdims=True) - mine
            has = (own.sum(axis=2, keepdims=True) - own).sum(axis=0) > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                j = np.where(has & (a > 0) & (b > 0), np.round(others[0] / a + (b - others[1]) / b - 1, 12), -np.inf)
            top = len(some) - 1 - j[::-1].argmax(axis=0)  # the lowest threshold of the best
            found = j[top, np.arange(len(names))]
            won = (found >= best) & (found > -np.inf)
            best, at = np.where(won, found, best), np.where(won, some[top], at)
            p0, n0 = p0 + own[0].sum(axis=0), n0 + own[1].sum(axis=0)
        keep = np.flatnonzero(best > -np.inf)
        return pa.table({"group_": before.column("fold_").take(pa.array(keep)), "j": pa.array(best[keep]), "threshold": pa.array(at[keep])})

    best = ranged.groupBy("range_").cogroup(base.groupBy("at_")).applyInArrow(choose, f"group_ {kind}, j double, threshold double")
    lowest = hist.groupBy("group_").agg(F.min("score").alias("m")).orderBy("m").limit(2).collect()
    if len(lowest) > 1:
        other = F.when(F.col("group_").eqNullSafe(F.lit(lowest[0]["group_"])), F.lit(lowest[1]["m"])).otherwise(F.lit(lowest[0]["m"]))
        classes = hist.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
        both = whole.where((all_of("p") < classes["p"]) & (all_of("n") < classes["n"]))
        best = best.union(both.select("group_", F.lit(0.0), other - 1))
    found = best.groupBy("group_").agg(F.max_by("threshold", F.struct("j", -F.col("threshold"))).alias("threshold"))
    none = whole.select("group_", F.lit(None).cast("double").alias("threshold"))
    return found.union(none).groupBy(F.col("group_").alias(group)).agg(F.coalesce(F.max("threshold"), F.lit(default)).alias("threshold"))


def evaluable(truth: Column, onset: Column, offset: Column, stim_on: Column, ongoing: Column, least: float = 3.0) -> Column:
    """Not so: a positive clip whose discharge began before the stimulation, or ended (not ongoing) within ``least`` seconds."""
    carried = true_if(onset < stim_on)
    short = ~true_if(ongoing != 0) & true_if(offset - onset < least)
    return ~(truth & (carried | short))


def onset_error(errors: DataFrame, error: str = "error", by: tuple[str, ...] = ()) -> DataFrame:
    """Median and Hazen quartiles of onset errors, for each of ``by``. Errors are aggregated to one row for each value first."""
    hist = errors.where(F.col(error).isNotNull()).groupBy(*by, F.col(error).cast("double").alias("score")).agg(F.count("*").alias("pos"), F.lit(0).cast("long").alias("neg"))
    t = totals_above(hist, by).select(*by, "score", F.col("pos_all").alias("n"), (F.col("pos_all") - F.col("pos_above")).alias("last"), (F.col("pos_all") - F.col("pos_above") - F.col("pos") + 1).alias("first"))
    n, quartiles = F.col("n"), {"median": 0.5, "q25": 0.25, "q75": 0.75}
    at = {c: F.greatest(F.lit(1.0), F.least(n.cast("double"), p * n + F.lit(0.5))) for c, p in quartiles.items()}
    value = lambda k: F.max(F.when((F.col("first") <= k) & (k <= F.col("last")), F.col("score")))
    ends = [x for c in quartiles for x in (value(F.floor(at[c])).alias(f"{c}_low"), value(F.least(n, F.floor(at[c]) + 1)).alias(f"{c}_high"))]
    found = t.groupBy(*by).agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n"), *ends)
    return found.select(*by, "n", *((F.col(f"{c}_low") + (F.col(f"{c}_high") - F.col(f"{c}_low")) * (at[c] - F.floor(at[c]))).alias(c) for c in quartiles))
