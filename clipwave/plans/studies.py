"""Whole studies composed of operators: cut clips, compare with annotations, build features, validate, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import evaluation as V
from ..operators import patterns as P
from ..sources import tables as T
from ..streaming import jobs


def clip_index(stims: DataFrame, session: str = "session", pre: float = 10.0, post: float = 10.0) -> DataFrame:
    """One row for each stimulation (``session``, ``pair``, ``on``, ``off``): its number, clip name, window and the session's next onset."""
    w = Window.partitionBy(session).orderBy("on", "off", "pair")
    n = stims.withColumns({"event": F.row_number().over(w), "next_stim_on": F.coalesce(F.lead("on").over(w), F.lit(float("inf")))})
    return n.withColumns({"clip": S.clip_name(F.col(session), F.col("event"), F.col("pair")), "clip_start": F.col("on") - pre, "clip_end": F.col("off") + post})


def cut_clips(segments: DataFrame, index: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Samples of each clip: segments (``session``, ``chan``, ``label``, ``rate``, ``first_sample``, ``samples``) that meet its window, trimmed to it and joined in order.

    An equi-join on stretches of time; only the overlapping part of a segment is shuffled."""
    end = F.col("first_sample") + F.size("samples")
    seg = segments.withColumn("b_", F.explode(F.sequence(F.floor(F.col("first_sample") / F.col("rate") / bucket), F.floor(end / F.col("rate") / bucket))))
    win = index.select("session", "clip", "clip_start", "clip_end", F.explode(F.sequence(F.floor(F.col("clip_start") / bucket), F.floor(F.col("clip_end") / bucket))).alias("b_"))
    a, b = F.ceil(F.col("clip_start") * F.col("rate")), F.floor(F.col("clip_end") * F.col("rate")) + 1
    met = seg.join(win, ["session", "b_"]).withColumns({"from_": F.greatest(a, F.col("first_sample")).cast("long"), "to_": F.least(b, end).cast("long")}).where("to_ > from_")
    part = met.select("clip", "chan", "label", "rate", "from_", F.slice("samples", (F.col("from_") - F.col("first_sample") + 1).cast("int"), (F.col("to_") - F.col("from_")).cast("int")).alias("part")).dropDuplicates(["clip", "chan", "from_"])
    grouped = part.groupBy("clip", "chan", "label", "rate").agg(F.array_sort(F.collect_list(F.struct("from_", "part"))).alias("p"))
    return grouped.select("clip", "chan", "label", "rate", F.col("p")[0]["from_"].alias("first_sample"), F.flatten(F.transform("p", lambda x: x["part"])).alias("samples"))


def export_clips(segments: DataFrame, done: DataFrame | None = None, pre: float = 10.0, post: float = 10.0, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """From recordings to clips: find stimulations, index them, leave out clips that are written already, cut the contacts of the stimulated electrode. Returns index and samples."""
    stims = jobs.session_stimulations(segments).select(F.col("clip").alias("session"), "pair", "on", "off")
    index = clip_index(stims, pre=pre, post=post)
    if done is not None:
        index = T.not_yet_written(index, done, "clip")
    if most is not None:
        index = index.orderBy("session", "event").limit(most)
    cut = cut_clips(segments.withColumnRenamed("clip", "session"), index)
    of_clip = index.select("clip", S.electrode(F.substring_index("pair", "-", 1)).alias("electrode"))
    return index, cut.join(of_clip, "clip").where(S.electrode(F.col("label")) == F.col("electrode")).drop("electrode")


def write_clips(index: DataFrame, cut: DataFrame, path: str) -> None:
    """Append clips to the folder ``path``: samples by session, one row for each contact, with the clip's metadata; and the index, whose rows a later run leaves out (``export_clips(done=...)``)."""
    named = index.select("clip", "session", F.col("pair").alias("stim_pair"), "event", "on", "off", "clip_start", "clip_end", "next_stim_on")
    cut.join(named, "clip").write.mode("append").partitionBy("session").parquet(f"{path}/clips")
    named.write.mode("append").parquet(f"{path}/index")


def evaluate(detections: DataFrame, annotations: DataFrame, by: tuple[str, ...] = (), post: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Detected discharges against annotations: one row for each replayed clip, and one of metrics for each of ``by``.

    ``detections``: ``by``, ``clip``, ``t``; a clip that was replayed without a detection has
    a row with null ``t``, one that wasn't replayed has none and is left out. ``annotations``: ``clip``,
    ``AD`` (y, n or other: not scored, but its time counts), ``AD_onset``, ``stimOn``, ``stimOff``.
    A detection counts from the stimulation to ``post`` seconds after its end. Onset errors by median and Hazen quartiles."""
    inside = (F.col("t") >= F.col("stimOn")) & (F.col("t") <= F.col("stimOff") + post)
    near = detections.groupBy(*by, "clip", "t").agg(F.lit(1).alias("x_")).join(annotations, "clip")
    each = near.groupBy(*by, "clip").agg(F.first("AD").alias("AD"), F.first("AD_onset").alias("gt_onset"), F.min(F.when(inside, F.col("t"))).alias("det_onset"), F.first((F.col("stimOff") + post - F.col("stimOn")) / 60).alias("minutes"))
    each = each.withColumn("detected", F.col("det_onset").isNotNull())
    scored = each.where("AD in ('y', 'n')")
    counts = V.confusion(scored, F.col("AD") == "y", F.col("detected"), by)
    minutes = each.groupBy(*by).agg(F.sum("minutes").alias("minutes"))
    wrong = F.when((F.col("AD") == "y") & F.col("detected"), F.col("det_onset") - F.col("gt_onset"))
    errors = V.onset_error(scored.select(*by, wrong.alias("error")), by=by).select(*by, *(F.col(c).alias(f"onset_{c}") for c in ("median", "q25", "q75")))
    one = lambda df: df if by else df.withColumn("o_", F.lit(1))
    on = list(by) or ["o_"]
    joined = one(counts).join(one(minutes), on).join(one(errors), on, "left").drop("o_")
    return each, joined.withColumn("fp_per_min", F.col("fp") / F.greatest(F.col("minutes"), F.lit(S.EPS)))


def compare_with_relays(stims: DataFrame, relays: DataFrame, keys: tuple[str, ...], low: float = -10.0, high: float = 3.0) -> DataFrame:
    """Each stimulation (``event``, ``on``, ``pair``) with the relay (``mark``, ``at``, ``pair``) nearest to it: yes, NO or no-ann."""
    near = P.nearest(stims, relays, keys, low, high).join(stims.select(*keys, "event", "pair"), [*keys, "event"])
    said = relays.select(*keys, "mark", F.col("pair").alias("relay_pair"))
    both = near.join(said, [*keys, "mark"], "left")
    return both.withColumn("match", F.when(F.col("mark").isNull(), "no-ann").when(F.col("pair") == F.col("relay_pair"), "yes").otherwise("NO"))


def match_rate(compared: DataFrame) -> DataFrame:
    """Share of yes among stimulations that have an annotation."""
    scored = F.when(F.col("match") != "no-ann", (F.col("match") == "yes").cast("double"))
    return compared.agg(F.count(scored).alias("scored"), F.avg(scored).alias("rate"))


def decision(first: Column, second: Column, ongoing: Column, last: Column) -> tuple[Column, Column]:
    """Onset and end of an annotated discharge: the clicks in order; one that goes on ends with the clip."""
    return F.least(first, second), F.when(S.true_if(ongoing), last).otherwise(F.greatest(first, second))


def validation_report(clips: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Each clip (``patient``, ``truth``, ``evaluable``, ``score``) judged by the threshold that the other patients choose."""
    folds = V.leave_one_out(clips.where("evaluable"), F.col("truth"), F.col("score"), "patient", threshold)
    return clips.join(folds, "patient", "left").withColumn("pred", F.col("score") > F.coalesce("threshold", F.lit(threshold)))


def review_counts(report: DataFrame) -> DataFrame:
    """Clips in each review category."""
    return report.groupBy(P.classify(F.col("truth"), F.col("pred"), F.col("evaluable")).alias("category")).agg(F.count("*").alias("n"))


def split_remote(path: Column) -> tuple[Column, Column]:
    """Host and folder of host:folder/ (first colon, no trailing slash)."""
    return F.substring_index(path, ":", 1), F.regexp_replace(F.regexp_replace(path, "^[^:]*:", ""), "/$", "")
