"""The clip detector: from clips (or features of any source) to scores, and their validation.

A clip is a row of ``clip``, ``stim_on`` and ``stim_off`` (seconds from its start),
``next_stim_on`` (null: none) and ``candidates`` (names of its bipolar channels, nearest
first). Features are one row for each clip and candidate, with its windows as arrays, so a
channel's baseline is one expression over its own row; only the run rule orders rows.

No clip is lost: without candidates, or without a window after the stimulation, the score is
minus infinity; without a window before it, centre and scale of the baseline are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dsp
from ..functions import scalars as S
from ..operators import channels as C
from ..operators import evaluation as V
from ..operators import patterns as P
from ..operators import recurrence as R
from ..operators import signal as G
from ..sources.shared import written


@dataclass(frozen=True)
class ClipParams:
    """Defaults of the clip detector, in seconds and Hz. Infinite ratios switch their guard off."""

    band: tuple[float, float] = (1.0, 50.0)
    order: int = 4
    window: float = 1.0
    candidates: int = 2
    trim: float = 0.2
    scale_floor: float = 0.25
    hf_band: tuple[float, float] = (70.0, 120.0)
    hf_z: float = 5.0
    hf_ratio: float = 1.0
    hf_spare: float = 0.2
    notch: bool = True
    line_ratio: float = 0.5
    margin: float = 0.5
    saturation: float = float("inf")
    dead_time: float = 2.0
    n: int = 3
    threshold: float = 4.0
    least_ad: float = 3.0
    specificity: float = 0.9


BASE = "base array<struct<ll:double,hf:double>>"
POST = "post array<struct<win:int,t:double,ll:double,hf:double,inband:double>>"
FEATURES = f"clip string, chan int, {BASE}, {POST}, line double, whole double"


def lists(column: pa.Array) -> list[np.ndarray]:
    """A list column as arrays of doubles; missing samples are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, ends = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def candidate_channels(contacts: DataFrame, clips: DataFrame, p: ClipParams = ClipParams()) -> DataFrame:  # noqa: B008
    """``clip``, ``chan`` (rank from 0), ``first``, ``second``: the bipolar channels nearest to the stimulated pair. ``contacts``: ``clip`` and ``label``; ``clips``: ``clip`` and ``stim_pair``."""
    a, b = F.substring_index("stim_pair", "-", 1), F.substring_index("stim_pair", "-", -1)
    stims = clips.select("clip", F.col("clip").alias("stim_id"), S.electrode(a).alias("electrode"), S.contact(a).alias("a"), S.contact(b).alias("b"))
    pairs = C.pairs(contacts.select("clip", "label").distinct(), ("clip",))
    return C.candidates(pairs, stims, p.candidates, ("clip",), same_electrode=False).select(F.col("stim_id").alias("clip"), (F.col("rank") - 1).cast("int").alias("chan"), "first", "second")


def bipolar(contacts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Samples of the chosen channels: ``clip``, ``chan``, ``rate``, ``samples``; missing ones are 0. ``contacts``: ``clip``, ``label``, ``rate``, ``samples``."""
    one = contacts.select("clip", F.col("label").alias("first"), "rate", F.col("samples").alias("x"))
    other = contacts.select("clip", F.col("label").alias("second"), F.col("samples").alias("y"))
    both = chosen.join(one, ["clip", "first"]).join(other, ["clip", "second"])
    return both.select("clip", "chan", "rate", F.zip_with("x", "y", lambda u, v: F.coalesce(F.nanvl(u - v, F.lit(None).cast("double")), F.lit(0.0))).alias("samples"))


def features(channels: DataFrame, clips: DataFrame, p: ClipParams = ClipParams()) -> DataFrame:  # noqa: B008
    """FEATURES of bipolar channels: windows before the stimulation begin at the clip's start, those after it at its end."""

    def of_batch(rate: float, x: np.ndarray, marks: list[tuple]) -> Iterator[tuple]:
        """Channels (columns) of one rate and length; ``marks``: clip, channel, on and off of each."""
        n, half = int(np.floor(p.window * rate + 0.5)), np.floor(rate / 2)
        y = dsp.run_sections(dsp.butter_band(p.order, *p.band, rate), x)
        if p.notch and rate / 2 > 62:
            y = dsp.run_sections(dsp.butter_band(2, 58, 62, rate, stop=True), y)
        top, high = min(p.hf_band[1], half - 5), min(50.0, half - 1)
        with_hf = np.isfinite(p.hf_ratio) and top > p.hf_band[0] + 5
        line = dsp.band_energy(x, rate, 59, 61) if np.isfinite(p.line_ratio) and rate / 2 > 61 else np.zeros(x.shape[1])
        whole = dsp.band_energy(x, rate, 1, high)
        for j, (clip, chan, on, off) in enumerate(marks):
            on, off = (max(0, int(np.floor(v * rate + 0.5))) for v in (on, off))
            cut = lambda starts: np.stack([np.arange(s, s + n) for s in starts], axis=1) if len(starts) else np.empty((n, 0), np.int64)
            base, starts = cut(range(0, min(on, len(x)) - n + 1, n)), range(off, len(x) - n + 1, n)
            post = cut(starts)
            length = lambda at: np.abs(np.diff(y[at, j], axis=0)).sum(axis=0)  # noqa: E731, B023
            power = lambda at, low, to: dsp.band_energy(x[at, j], rate, low, to) if at.size else np.empty(0)  # noqa: E731, B023
            fast = lambda at: power(at, p.hf_band[0], top) if with_hf else np.zeros(at.shape[1])  # noqa: E731, B023
            before = [{"ll": a, "hf": b} for a, b in zip(length(base).tolist(), fast(base).tolist(), strict=True)]
            after = [{"win": k, "t": s / rate, "ll": a, "hf": b, "inband": c} for k, (s, a, b, c) in enumerate(zip(starts, length(post).tolist(), fast(post).tolist(), power(post, 1, high).tolist(), strict=True))]
            yield clip, chan, before, after, float(line[j]), float(whole[j])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict[tuple, list] = {}
            plain = zip(*(b.column(c).to_pylist() for c in ("clip", "chan", "rate", "stim_on", "stim_off")), strict=True)
            for (clip, chan, rate, on, off), x in zip(plain, lists(b.column("samples")), strict=True):
                groups.setdefault((rate, len(x)), []).append((x, (clip, chan, on, off)))
            rows = [r for (rate, _), g in groups.items() for r in of_batch(rate, np.nan_to_num(np.stack([x for x, _ in g], axis=1)), [m for _, m in g])]
            if rows:
                struct = lambda names, kinds: pa.list_(pa.struct([pa.field(k, t) for k, t in zip(names, kinds, strict=True)]))
                kinds = (pa.string(), pa.int32(), struct(("ll", "hf"), [pa.float64()] * 2), struct(("win", "t", "ll", "hf", "inband"), [pa.int32(), *[pa.float64()] * 4]), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["clip", "chan", "base", "post", "line", "whole"])

    timed = channels.join(clips.select("clip", "stim_on", "stim_off"), "clip").where(F.size("samples") > 0)
    return timed.select("clip", "chan", "rate", "samples", "stim_on", "stim_off").mapInArrow(work, FEATURES)


def sample_features(rows: DataFrame, clips: DataFrame, rate: float, p: ClipParams = ClipParams()) -> DataFrame:  # noqa: B008
    """FEATURES as ``features`` gives them, without Python: filters as scans, band powers as sums of bins. ``rows``: ``clip``, ``chan``, ``i`` (from 0) and ``x``, null counts as 0; ``clips``: ``clip``, ``stim_on``, ``stim_off`` in seconds from the clip's start.

    A channel is dealt by blocks while it is filtered, then by windows; only a channel's own features, and its raw samples for the line noise of the whole clip, come together in a row."""
    n, half = int(np.floor(p.window * rate + 0.5)), np.floor(rate / 2)
    sections = dsp.butter_band(p.order, *p.band, rate)
    if p.notch and rate / 2 > 62:
        sections = np.concatenate([sections, dsp.butter_band(2, 58, 62, rate, stop=True)])
    top, high = min(p.hf_band[1], half - 5), min(50.0, half - 1)
    with_hf = np.isfinite(p.hf_ratio) and top > p.hf_band[0] + 5
    rows = rows.select("clip", F.col("chan").cast("int").alias("chan"), "i", F.coalesce(F.nanvl(F.col("x").cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias("x"))
    y = R.filtered(rows, sections, ("clip", "chan"), "i", "x", "y")
    mark = lambda c: F.greatest(F.lit(0), F.floor(F.col(c) * rate + 0.5).cast("long"))
    y = y.join(clips.select("clip", mark("stim_on").alias("on_"), mark("stim_off").alias("off_")), "clip")
    place = lambda side, win, end, start: F.struct(F.lit(side).alias("side"), F.floor(win / n).cast("int").alias("win"), end.cast("long").alias("end"), start.cast("long").alias("start"))
    before = F.when(F.col("i") < F.col("on_"), place(0, F.col("i"), F.col("on_"), F.lit(0)))
    behind = F.when(F.col("i") >= F.col("off_"), place(1, F.col("i") - F.col("off_"), F.lit(None), F.col("off_")))
    places = F.array(before, behind)
    w = y.withColumn("place_", F.explode(F.filter(places, lambda v: v.isNotNull()))).groupBy("clip", "chan", "place_").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("s"))
    # Complete windows: the last before the stimulation ends with it.
    whole_window = (F.size("s") == n) & F.coalesce((F.col("place_.win") + 1) * n <= F.col("place_.end"), F.lit(True))
    xs, ys = F.transform("s", lambda v: v["x"]), F.transform("s", lambda v: v["y"])
    w = w.where(whole_window).select("clip", "chan", "place_.side", "place_.win", ((F.col("place_.start") + F.col("place_.win") * n) / F.lit(float(rate))).alias("t"), G.line_length_of(ys).alias("ll"), (G.band_energy_of(xs, rate, p.hf_band[0], top) if with_hf else F.lit(0.0)).alias("hf"), G.band_energy_of(xs, rate, 1, high).alias("inband"))
    base, post = F.when(F.col("side") == 0, F.struct("ll", "hf")), F.when(F.col("side") == 1, F.struct("win", "t", "ll", "hf", "inband"))
    parts = w.groupBy("clip", "chan").agg(F.collect_list(base).alias("base"), F.array_sort(F.collect_list(post)).alias("post"))
    raw = rows.groupBy("clip", "chan").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("s"))
    line = G.band_energy_of(F.col("s"), rate, 59, 61) if np.isfinite(p.line_ratio) and rate / 2 > 61 else F.lit(0.0)
    ends = raw.select("clip", "chan", F.coalesce(line, F.lit(0.0)).alias("line"), F.coalesce(G.band_energy_of(F.col("s"), rate, 1, high), F.lit(0.0)).alias("whole"))
    none = lambda c: F.coalesce(c, F.array().cast(parts.schema[c].dataType))
    return ends.join(parts, ["clip", "chan"], "left").select("clip", "chan", none("base").alias("base"), none("post").alias("post"), "line", "whole")


def saturation_from(contacts: DataFrame, clips: DataFrame, p: ClipParams) -> DataFrame:
    """``clip`` and ``cut``: the first of two consecutive windows after the stimulation in which a stimulated contact is louder than ``saturation`` of its loudest during it; windows in the dead time don't count. ``clips``: with ``stim_pair``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            peaks, loud = [], []
            for rate, on, off, x in zip(*(b.column(c).to_pylist() for c in ("rate", "stim_on", "stim_off")), lists(b.column("samples")), strict=True):
                n = int(np.floor(p.window * rate + 0.5))
                on, off, x = int(np.floor(on * rate + 0.5)), int(np.floor(off * rate + 0.5)), np.abs(np.nan_to_num(x))
                peaks.append(float(x[max(0, on) : off + 1].max(initial=0)))
                loud.append([float(x[s : s + n].max()) for s in range(max(0, off), len(x) - n + 1, n)])
            yield pa.RecordBatch.from_arrays([b.column("clip"), pa.array(peaks), pa.array(loud, pa.list_(pa.float64()))], names=["clip", "peak", "loud"])

    pair = F.split("stim_pair", "-")
    stimulated = contacts.join(clips.select("clip", "stim_on", "stim_off", "stim_pair"), "clip").where(F.array_contains(pair, F.col("label")))
    found = stimulated.select("clip", "rate", "samples", "stim_on", "stim_off").mapInArrow(work, "clip string, peak double, loud array<double>")
    windows = found.select("clip", "peak", F.posexplode("loud").alias("win", "loud")).groupBy("clip", "win").agg(F.max("peak").alias("peak"), F.max("loud").alias("loud"))
    dead = int(np.ceil(p.dead_time / p.window))
    over = (F.col("peak") > 0) & (F.col("loud") > p.saturation * F.col("peak")) & (F.col("win") >= dead)
    return G.saturation_cut(windows, over, ("clip",), "win").where("cut").groupBy("clip").agg(F.min("win").alias("cut"))


def middle(values: Column) -> Column:
    """Median of a sorted array; 0 without values."""
    n = F.size(values)
    at = lambda k: F.get(values, F.floor(k).cast("int"))
    return F.coalesce((at((n - 1) / 2) + at(n / 2)) / 2, F.lit(0.0))


def with_baselines(found: DataFrame, p: ClipParams) -> DataFrame:
    """``med`` and ``mad`` of the lowest line lengths before the stimulation (without the upper ``trim``), ``hf_med`` and ``hf_mad`` of all high-frequency energies there. Each step is a column of its own, so nothing is sorted twice."""
    sorted_ = lambda c: F.array_sort(F.transform("base", lambda b: b[c]))
    f = found.withColumns({"ll_": sorted_("ll"), "hf_": sorted_("hf"), "n_base": F.size("base")})
    f = f.withColumn("ll_", F.slice("ll_", F.lit(1), F.greatest(F.lit(1), F.floor(F.size("ll_") * (1 - p.trim) + 1e-9)).cast("int")))
    f = f.withColumns({"med": middle(F.col("ll_")), "hf_med": middle(F.col("hf_"))})
    away = lambda values, centre: F.array_sort(F.transform(values, lambda x: F.abs(x - F.col(centre))))
    f = f.withColumns({"ll_": away("ll_", "med"), "hf_": away("hf_", "hf_med")})
    return f.withColumns({"mad": middle(F.col("ll_")), "hf_mad": middle(F.col("hf_"))}).drop("ll_", "hf_")


def windows(found: DataFrame, clips: DataFrame, p: ClipParams = ClipParams(), cuts: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """``clip``, ``chan``, ``win``, ``t``, ``z`` and ``valid`` of every window after the stimulation, with what vetoed it: ``hf_bad``, ``line_bad``, ``cap_bad``."""
    f = with_baselines(found, p)
    f = f.withColumn("gmed", F.median("med").over(Window.partitionBy("clip")))
    w = f.select("clip", "chan", "med", "mad", "gmed", "hf_med", "hf_mad", "n_base", "line", "whole", F.explode("post").alias("w")).select("*", "w.*")
    scale = F.greatest(1.4826 * F.col("mad"), p.scale_floor * F.col("gmed")) + S.EPS
    z_hf = F.when(F.col("n_base") > 0, (F.col("hf") - F.col("hf_med")) / (1.4826 * F.col("hf_mad") + S.EPS)).otherwise(0.0)
    w = w.join(clips.select("clip", "next_stim_on"), "clip")
    capped = G.next_stim_veto(F.col("t"), F.col("next_stim_on"), p.margin)
    if cuts is not None:
        w = w.join(cuts, "clip", "left")
        capped = capped | S.true_if(F.col("win") >= F.col("cut"))
    bad = {"hf_bad": G.hf_veto(F.col("hf"), F.col("inband"), z_hf, p.hf_spare, p.hf_z, p.hf_ratio), "line_bad": G.line_noise_veto(F.col("line"), F.col("whole"), p.line_ratio), "cap_bad": capped}
    w = w.withColumns({"z": (F.col("ll") - F.col("med")) / scale, **bad})
    return w.select("clip", "chan", "win", "t", "z", (~F.col("hf_bad") & ~F.col("line_bad") & ~F.col("cap_bad")).alias("valid"), *bad)


def scores(judged: DataFrame, clips: DataFrame, p: ClipParams = ClipParams()) -> DataFrame:  # noqa: B008
    """``clip``, ``score``, ``detected``, ``pair`` and ``onset`` (seconds from the clip's start) of every clip; channel and onset are those of the best run."""
    best = P.run_score(judged, p.n)
    all_ = clips.select("clip", "stim_off", "candidates").join(best, "clip", "left")
    score = F.coalesce("score", F.lit(P.LOWEST))
    return all_.select("clip", score.alias("score"), (score > p.threshold).alias("detected"), F.try_element_at("candidates", F.col("chan") + 1).alias("pair"), (F.greatest(F.lit(0.0), F.col("stim_off")) + F.col("onset_win") * p.window).alias("onset"))


def detect(contacts: DataFrame, clips: DataFrame, p: ClipParams = ClipParams()) -> DataFrame:  # noqa: B008
    """Scores of clips from their contacts' samples (``clip``, ``label``, ``rate``, ``samples``). ``clips``: ``clip``, ``stim_pair``, ``stim_on``, ``stim_off``, ``next_stim_on``."""
    chosen = candidate_channels(contacts, clips, p)
    names = chosen.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("chan", F.concat_ws("-", "first", "second").alias("name")))).alias("c"))
    listed = clips.join(names, "clip", "left").withColumn("candidates", F.coalesce(F.transform("c", lambda x: x["name"]), F.array().cast("array<string>")))
    cuts = saturation_from(contacts, clips, p) if np.isfinite(p.saturation) else None
    return scores(windows(features(bipolar(contacts, chosen), clips, p), listed, p, cuts), listed, p)


def with_next_stim(clips: DataFrame, stims: DataFrame) -> DataFrame:
    """``clips`` (``clip``, ``session``, ``clip_start``, ``on``, ``off`` in seconds of the session) with ``stim_on``, ``stim_off`` and ``next_stim_on`` from the clip's start: the first of the session's stimulations (``session``, ``on``) after the clip's own end."""
    events = clips.select("session", "clip", "on", "off").unionByName(stims.select("session", F.lit(None).cast("string").alias("clip"), "on", F.col("on").alias("off")))
    nxt = P.next_onset(events, ("session",)).where("clip is not null").select("clip", F.col("next_on").alias("next_"))
    from_start = lambda c: F.col(c) - F.col("clip_start")
    return clips.join(nxt, "clip", "left").withColumns({"stim_on": from_start("on"), "stim_off": from_start("off"), "next_stim_on": from_start("next_")}).drop("next_")


def build_features(scored: DataFrame, clips: DataFrame, annotations: DataFrame, p: ClipParams = ClipParams(), patient: str = "HUP[0-9]+") -> DataFrame:  # noqa: B008
    """Annotated clips (AD is y or n) with what validation needs: ``patient``, ``truth``, ``evaluable``, ``score``, ``onset`` in seconds of the session, the annotated ``AD_onset``, and ``minutes`` after the stimulation."""
    a = annotations.where("AD in ('y', 'n')").select(F.col("clip_name").alias("clip"), "ieeg_name", (F.col("AD") == "y").alias("truth"), "AD_onset", "AD_offset", "ad_ongoing")
    both = a.join(clips.select("clip", "clip_start", "clip_end", "on", "off"), "clip").join(scored.select("clip", "score", "onset"), "clip")
    fit = V.evaluable(F.col("truth"), F.col("AD_onset"), F.col("AD_offset"), F.col("on"), F.col("ad_ongoing"), p.least_ad)
    return both.select("clip", S.group_id(F.col("ieeg_name"), patient).alias("patient"), "truth", fit.alias("evaluable"), "score", (F.col("clip_start") + F.col("onset")).alias("onset"), "AD_onset", ((F.col("clip_end") - F.col("off")) / 60).alias("minutes"))


def validate(built: DataFrame, p: ClipParams = ClipParams()) -> DataFrame:  # noqa: B008
    """One row: pooled counts and rates of the clips judged by the thresholds of the other patients, false positives a minute, onset errors, AUC, sensitivity at the wanted specificity, suggested threshold."""
    built = written(built.where("evaluable"), "validated-clips")
    folds = written(V.leave_one_out(built, F.col("truth"), F.col("score"), "patient", p.threshold), "validated-folds")
    judged = built.join(folds, "patient", "left").withColumn("pred", F.col("score") > F.coalesce("threshold", F.lit(p.threshold)))
    counts = V.confusion(judged, F.col("truth"), F.col("pred"), empty="zero")
    minutes = judged.agg(F.coalesce(F.sum(F.when(~F.col("truth"), F.col("minutes"))), F.lit(0.0)).alias("minutes"))
    errors = V.onset_error(judged.where("truth and pred").select((F.col("onset") - F.col("AD_onset")).alias("error"))).select(*(F.col(c).alias(f"onset_{c}") for c in ("median", "q25", "q75")))
    hist = V.histogram(built, F.col("truth"), F.col("score"))
    at = V.at_specificity(hist, p.specificity).select(F.col("threshold").alias("threshold_at_spec"), F.col("sens").alias("sens_at_spec"), F.col("spec").alias("spec_actual"))
    one = lambda df: df.withColumn("one_", F.lit(1))  # noqa: E731  rows of one
    out = one(counts)
    for part in (minutes, errors, V.roc_auc(hist), at, folds.agg(F.median("threshold").alias("suggested"))):
        out = out.join(one(part), "one_")
    return out.withColumn("fp_per_min", F.col("fp") / F.greatest(F.col("minutes"), F.lit(S.EPS))).drop("one_")
