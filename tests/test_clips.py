"""The clip detector on clips whose windows are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipwave.functions import dsp
from clipwave.plans import clips, studies
from clipwave.sources import eeg
from clipwave.streaming import jobs

RATE = 256.0
CONTACTS = "clip string, label string, rate double, samples array<double>"
CLIPS = "clip string, session string, stim_pair string, stim_on double, stim_off double, next_stim_on double"


def contacts(clip, seconds, discharge=None, labels=6):
    """Quiet contacts LA1 to LA6; ``discharge``: from and to, on LA5."""
    rng = np.random.default_rng(1)
    t = np.arange(int(seconds * RATE)) / RATE
    rows = []
    for k in range(1, labels + 1):
        x = 10 * np.sin(2 * np.pi * 9 * t + k) + rng.normal(0, 1, len(t))
        if k == 5 and discharge:
            x += 300 * np.sin(2 * np.pi * 12 * t) * ((t >= discharge[0]) & (t < discharge[1]))
        rows.append((clip, f"LA{k}", RATE, x.tolist()))
    return rows


@pytest.fixture(scope="module")
def study(spark):
    rows = contacts("quiet", 24) + contacts("ad", 24, (13, 20)) + contacts("next", 24, (13, 20)) + contacts("short", 11, None) + contacts("early", 16, (5, 12)) + contacts("alone", 24, None, 2)
    listed = [("quiet", 10.0, 12.0, None), ("ad", 10.0, 12.0, None), ("next", 10.0, 12.0, 15.0), ("short", 9.0, 10.5, None), ("early", 0.3, 2.0, None), ("alone", 10.0, 12.0, None), ("lost", 1.0, 2.0, None)]
    df = spark.createDataFrame([(c, "s", "LA3-LA2" if c != "alone" else "LA1-LA2", on, off, n) for c, on, off, n in listed], CLIPS)
    return spark.createDataFrame(rows, CONTACTS).repartition(3), df


def test_windows_of_a_clip(spark, study):
    chosen = clips.candidate_channels(*study)
    named = {(r["clip"], r["chan"]): (r["first"], r["second"]) for r in chosen.collect()}
    assert named["ad", 0] == ("LA4", "LA5") and named["ad", 1] == ("LA5", "LA6") and not any(c == "alone" for c, _ in named)
    found = {(r["clip"], r["chan"]): r for r in clips.features(clips.bipolar(study[0], chosen), study[1]).collect()}
    sizes = {c: (len(r["base"]), len(r["post"])) for (c, k), r in found.items() if k == 0}
    assert sizes == {"quiet": (10, 12), "ad": (10, 12), "next": (10, 12), "short": (9, 0), "early": (0, 14)}
    assert [w["t"] for w in found["ad", 0]["post"]][:3] == [12.0, 13.0, 14.0]
    raw = {r["label"]: np.array(r["samples"]) for r in study[0].where("clip = 'ad'").collect()}
    y = dsp.run_sections(dsp.butter_band(4, 1, 50, RATE), (raw["LA4"] - raw["LA5"])[:, None])
    y = dsp.run_sections(dsp.butter_band(2, 58, 62, RATE, stop=True), y)[:, 0]
    for k, w in enumerate(found["ad", 0]["base"]):
        assert w["ll"] == pytest.approx(np.abs(np.diff(y[k * 256 : k * 256 + 256])).sum())


def test_scores_of_all_clips(spark, study):
    out = {r["clip"]: r for r in clips.detect(*study).collect()}
    assert set(out) == {"quiet", "ad", "next", "short", "early", "alone", "lost"}
    assert out["ad"]["detected"] and out["ad"]["pair"] in ("LA4-LA5", "LA5-LA6") and out["ad"]["onset"] >= 12
    assert not out["quiet"]["detected"] and out["quiet"]["score"] > float("-inf")
    assert out["next"]["score"] < out["ad"]["score"] and not out["next"]["detected"]  # only 12, 13 and 14 begin before 14.5
    assert {out[c]["score"] for c in ("short", "alone", "lost")} == {float("-inf")}
    assert out["early"]["detected"] and out["early"]["score"] > 1e6  # no baseline: centre and scale 0
    plan = clips.detect(*study)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2


def test_next_stim_and_saturation(spark, study):
    p = clips.ClipParams(saturation=0.5)
    t = np.arange(int(24 * RATE)) / RATE
    loud = lambda a, b: ((t >= a) & (t < b)) * 100.0
    x = loud(10, 12) + loud(12, 13.5) * 0.9 + loud(17, 20)
    df = spark.createDataFrame([("c", "LA3", RATE, x.tolist()), ("c", "LA2", RATE, (x * 0).tolist())], CONTACTS)
    one = spark.createDataFrame([("c", "s", "LA2-LA3", 10.0, 12.0, None)], CLIPS)
    assert [(r["clip"], r["cut"]) for r in clips.saturation_from(df, one, p).collect()] == [("c", 5)]
    listed = spark.createDataFrame([("a", "s", 90.0, 100.0, 102.0), ("b", "s", 95.0, 105.0, 107.0), ("c", "t", 0.0, 10.0, 12.0)], "clip string, session string, clip_start double, on double, off double")
    stims = listed.select("session", "on").union(spark.createDataFrame([("s", 130.0)], "session string, on double"))
    got = {r["clip"]: r["next_stim_on"] for r in clips.with_next_stim(listed, stims).collect()}
    assert got == {"a": 15.0, "b": 35.0, "c": float("inf")}


def test_validation(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{k}", f"HUP{k % 4}_phaseII", "y" if k % 2 else "n", 13.0 if k % 2 else None, 19.0 if k % 2 else None, 0.0) for k in range(40)] + [("c40", "HUP1_x", "u", None, None, None), ("c41", "HUP1_x", "y", 5.0, 9.0, 0.0)]
    marks = spark.createDataFrame(rows, "clip_name string, ieeg_name string, AD string, AD_onset double, AD_offset double, ad_ongoing double")
    listed = spark.createDataFrame([(f"c{k}", 0.0, 24.0, 10.0, 12.0) for k in range(42)], "clip string, clip_start double, clip_end double, on double, off double")
    scored = spark.createDataFrame([(f"c{k}", float((6 if k % 2 else 2) + rng.random()), 13.5) for k in range(42)], "clip string, score double, onset double")
    built = clips.build_features(scored, listed, marks)
    assert built.count() == 41 and built.where("not evaluable").count() == 1 and {r[0] for r in built.select("patient").distinct().collect()} == {"HUP0", "HUP1", "HUP2", "HUP3"}
    r = clips.validate(built).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (20, 0, 1, 19) and r["auc"] == 1.0 and r["onset_median"] == 0.5
    assert 2 < r["suggested"] < 6 and r["minutes"] == pytest.approx(20 * 12 / 60) and r["fp_per_min"] == pytest.approx(1 / 4)  # the loudest negative is over the others' choice


def test_leave_one_out_like_brute_force(spark):
    from clipwave.operators import evaluation as V

    rng = np.random.default_rng(5)
    rows = [(f"g{rng.integers(0, 6)}", bool(rng.random() < 0.4), float(rng.integers(0, 30))) for _ in range(150)] + [("only", True, 99.0), ("low", False, -7.0)]
    df = spark.createDataFrame(rows, "g string, y boolean, s double")
    got = {r["g"]: r["threshold"] for r in V.leave_one_out(df, F.col("y"), F.col("s"), "g", 1.5).collect()}
    for g in {r[0] for r in rows}:
        rest = [(y, s) for h, y, s in rows if h != g]
        pos, neg = sum(y for y, _ in rest), sum(not y for y, _ in rest)
        every = sorted({s for _, s in rest} | {min(s for _, s in rest) - 1})
        j = {t: round(sum(y and s > t for y, s in rest) / pos + sum(not y and s <= t for y, s in rest) / neg - 1, 12) for t in every}
        assert got[g] == min(t for t in every if j[t] == max(j.values())), g
    two = spark.createDataFrame([("a", True, 1.0), ("b", False, 2.0)], "g string, y boolean, s double")
    assert {r["threshold"] for r in V.leave_one_out(two, F.col("y"), F.col("s"), "g", 1.5).collect()} == {1.5}


def test_replay_in_blocks_of_any_size(spark):
    s = eeg.read_eeg(spark, clips=2, seconds=16, rate=1000, piece_seconds=7)
    log = jobs.replay_by_size(s, (100, 250)).collect()
    by = {ms: sorted((r["clip"], r["kind"], r["channel"], r["t"]) for r in log if r["block_ms"] == ms) for ms in (100, 250)}
    assert by[100] and by[100] == by[250]
    marks = spark.createDataFrame([("S_1_ev00_LA3-LA4", "n", None, 10.0, 12.0), ("S_1_ev01_LA3-LA4", "y", 12.0, 10.0, 12.0), ("gone", "y", 1.0, 0.0, 1.0)], "clip string, AD string, AD_onset double, stimOn double, stimOff double")
    found = spark.createDataFrame([(r["clip"], r["t"] if r["kind"] == "ad" else None) for r in log if r["block_ms"] == 100], "clip string, t double")
    each, metrics = studies.evaluate(found, marks)
    m = metrics.first()
    assert each.count() == 2 and (m["tp"], m["fn"], m["fp"], m["tn"]) == (1, 0, 0, 1) and m["sens"] == 1.0
    assert m["minutes"] == pytest.approx(14 / 60) and 0 < m["onset_median"] < 5


def test_clips_are_written_once(spark, tmp_path):
    s = eeg.read_eeg(spark, clips=2, seconds=20, rate=500, piece_seconds=11)
    index, cut = studies.export_clips(s, pre=3, post=3)
    studies.write_clips(index, cut, str(tmp_path / "out"))
    back, done = spark.read.parquet(str(tmp_path / "out/clips")), spark.read.parquet(str(tmp_path / "out/index"))
    assert done.count() == 2 and back.count() == 16 and {"stim_pair", "clip_start", "session"} <= set(back.columns)
    assert studies.export_clips(s, done=done, pre=3, post=3)[0].count() == 0


def test_lost_block_does_not_stall(spark, monkeypatch):
    class State:
        exists, hasTimedOut, kept = False, False, None

        def update(self, value):
            self.exists, self.kept = True, value

        @property
        def get(self):
            return self.kept

    import pandas as pd

    monkeypatch.setattr(jobs, "MOST_WAITING", 3)
    state = State()
    frame = pd.DataFrame([{"clip": "c", "rate": 1000.0, "labels": ["LA1", "LA2"], "seq": k, "block": [[1.0] * 100, [2.0] * 100]} for k in (0, 2, 3, 4, 5)])
    list(jobs.step(("c",), iter([frame]), state))
    assert state.kept[1] == 6


def test_edf_labels():
    assert eeg.edf_labels(["LA1", "LA1", "é", "x" * 20, "x" * 20, ""]) == ["LA1", "LA1_2", "_", "x" * 16, "x" * 14 + "_2", "chan"]
