"""Small cases worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipwave.functions import scalars as S
from clipwave.operators import channels as C
from clipwave.operators import evaluation as V
from clipwave.operators import patterns as P
from clipwave.operators import signal as G
from clipwave.sources import tables as T


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def labels(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "label string")


def test_labels(spark):
    df = labels(spark, "LA01", "LA001", "LA0", "LA10", "C3", "CZ")
    got = {r[0]: r[1] for r in df.select("label", S.normalize_label(F.col("label"))).collect()}
    assert got == {"LA01": "LA1", "LA001": "LA01", "LA0": "LA", "LA10": "LA10", "C3": "C3", "CZ": "CZ"}
    one = spark.range(1).select(S.pair_string(F.lit("LA9"), F.lit("LA10")).alias("p"), S.clip_name(F.lit("S_1"), F.lit(3), F.lit("LB3-LB4")).alias("c")).first()
    assert one["p"] == "LA10-LA9" and one["c"] == "S_1_ev03_LB3-LB4"
    assert spark.range(1).select(S.session_of_clip(F.lit("S_1_ev03_LB3-LB4"))).first()[0] == "S_1"


def test_hazen(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([5.0],), ([],)], "v array<double>")
    assert [tuple(r) for r in df.select(S.hazen(F.col("v"), 0.25), S.hazen(F.col("v"), 0.75)).collect()] == [(1.5, 3.5), (5.0, 5.0), (None, None)]
    rng = np.random.default_rng(1)
    for n in (2, 5, 11):
        v = rng.normal(size=n)
        got = spark.createDataFrame([(v.tolist(),)], "v array<double>").select(S.hazen(F.col("v"), 0.3)).first()[0]
        assert got == pytest.approx(np.quantile(v, 0.3, method="hazen"))


def test_pairs_and_partners(spark):
    df = labels(spark, "LA1", "LA2", "LA4", "LB1", "LB2")
    assert rows(C.pairs(df).select("first", "second"), "first") == [("LA1", "LA2"), ("LB1", "LB2")]
    assert {r[0]: r[1] for r in C.partners(df).select("label", "alt").collect()} == {"LA1": "LA2", "LA2": None, "LA4": None, "LB1": "LB2", "LB2": None}


@pytest.mark.parametrize(("stim", "names", "want"), [((5, 6), range(1, 9), ["LA3-LA4", "LA7-LA8"]), ((1, 2), range(1, 9), ["LA3-LA4", "LA4-LA5"]), ((3, 4), range(2, 6), [])])
def test_candidates(spark, stim, names, want):
    df = labels(spark, *(f"LA{k}" for k in names))
    stims = spark.createDataFrame([(0, "LA", *stim)], "stim_id int, electrode string, a int, b int")
    got = C.candidates(C.pairs(df), stims, 2).orderBy("rank").collect()
    assert [f"{r['first']}-{r['second']}" for r in got] == want


def test_clip_channels_and_eligible(spark):
    df = labels(spark, "LB1", "LB2", "LB10", "LB3", "LBX1")
    assert [r[0] for r in rows(C.clip_channels(df, ("LB2", "LB3")), "number")] == ["LB1", "LB2", "LB3", "LB10"]
    assert [r[0] for r in rows(C.clip_channels(df, ("LB2", "LB3"), "neighbors"), "number")] == ["LB1", "LB2", "LB3"]
    df = labels(spark, *(f"LA{k}" for k in range(1, 13)))
    assert {r[0] for r in C.eligible(df, ("LA3", "LA4")).collect()} == {"LA1", *(f"LA{k}" for k in range(5, 11))}


def test_relay_text(spark):
    df = spark.createDataFrame([("Closed relay to LA03 and LA04",), ("nothing",)], "d string")
    a, b = S.relay_channels(F.col("d"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [("LA3", "LA4"), (None, None)]


EVENTS = "rec int, event long, kind string, on double, off double"


def test_merge(spark):
    df = spark.createDataFrame([(1, 1, "A", 0.0, 1.0), (1, 2, "A", 2.0, 3.0), (1, 3, "B", 3.5, 4.0), (1, 4, "A", 4.5, 5.0), (2, 5, "A", 0.0, 1.0), (2, 6, "A", 4.0, 5.0)], EVENTS)
    got = rows(P.merge_events(df, 3.0, ("rec",), "kind").select("rec", "kind", "on", "off"), "rec", "on")
    assert got == [(1, "A", 0.0, 3.0), (1, "B", 3.5, 4.0), (1, "A", 4.5, 5.0), (2, "A", 0.0, 1.0), (2, "A", 4.0, 5.0)]


def test_merge_like_a_loop(spark):
    rng = np.random.default_rng(3)
    data, want = [], []
    for rec in range(30):
        on = np.sort(rng.choice(200, size=12, replace=False) / 4.0)
        ev = [(rec, i, "AB"[rng.integers(2)], float(t), float(t + rng.integers(1, 30) / 4)) for i, t in enumerate(on)]
        data += ev
        now = None
        for _, _, k, a, b in ev:
            if now and now[1] == k and a - now[3] < 3:
                now[3] = max(now[3], b)
            else:
                now = [rec, k, a, b]
                want.append(now)
    got = rows(P.merge_events(spark.createDataFrame(data, EVENTS), 3.0, ("rec",), "kind").select("rec", "kind", "on", "off"), "rec", "on")
    assert got == [tuple(w) for w in want]


def test_nearest(spark):
    e = spark.createDataFrame([(1, 1, "x", 100.0, 101.0), (2, 2, "x", 100.0, 101.0), (3, 3, "x", 1.0, 2.0)], EVENTS)
    m = spark.createDataFrame([(1, 10, 95.0), (1, 11, 101.0), (1, 12, 104.0), (2, 20, 50.0), (2, 21, 110.0)], "rec int, mark long, at double")
    got = {r["event"]: r["mark"] for r in P.nearest(e, m, ("rec",), -10, 3).collect()}
    assert got == {1: 11, 2: 21, 3: None}


def test_next_onset(spark):
    e = spark.createDataFrame([(1, 1, "x", 10.0, 20.0), (1, 2, "x", 20.0, 20.5), (1, 3, "x", 30.0, 31.0)], EVENTS)
    assert rows(P.next_onset(e, ("rec",)).select("event", "next_on"), "event") == [(1, 30.0), (2, 30.0), (3, float("inf"))]


def z_rows(spark, *channels, bad=()):
    return spark.createDataFrame([(1, c, w, float(z), (c, w) not in bad) for c, zs in enumerate(channels) for w, z in enumerate(zs)], "clip int, chan int, win int, z double, valid boolean")


@pytest.mark.parametrize(
    ("channels", "bad", "want"),
    [
        (([5, 6, 7, 1], [5, 5, 5, 5]), (), (5.0, 0, 0)),
        (([4.5, 5, 6, 7, 8],), (), (6.0, 0, 2)),
        (([5, 6, 7, 8],), ((0, 1),), (float("-inf"), None, None)),
        (([5, 6],), (), (float("-inf"), None, None)),
    ],
)
def test_run_rule(spark, channels, bad, want):
    r = P.run_score(z_rows(spark, *channels, bad=bad), 3).first()
    assert (r["score"], r["chan"], r["onset_win"]) == want


def test_threshold_is_strict(spark):
    assert not P.detect(P.run_score(z_rows(spark, [4, 4, 4]), 3), 4.0).first()["detected"]


def test_runs(spark):
    z = z_rows(spark, [1, 1, 0, 1, 1, 1])
    r = P.runs(z, F.col("z") > 0.5, ("clip", "chan"), "win")
    assert rows(r.select("start", "stop", "length"), "start") == [(0, 1, 2), (3, 5, 3)]
    assert rows(P.near_misses(r).select("start", "stop"), "start") == [(0, 1)]


def test_baseline_and_line_length(spark):
    ll = spark.createDataFrame([(1, 0, float(k)) for k in range(1, 11)], "clip int, chan int, ll double")
    b = G.robust_baseline(ll, keys=("clip",)).first()
    assert (b["med"], b["mad"], b["n_baseline"]) == (4.5, 2.0, 8)
    assert spark.range(1).select(G.line_length_of(F.array(*map(F.lit, (1.0, 3.0, 2.0, 2.0))))).first()[0] == 3.0


def test_vetoes(spark):
    q = lambda hf, z: spark.range(1).select(G.hf_veto(F.lit(hf), F.lit(1.0), F.lit(z))).first()[0]
    assert not q(0.15, 50.0) and q(0.3, 5.0) and q(1.5, 0.0) and not q(0.3, 4.9)
    assert spark.range(1).select(G.next_stim_veto(F.lit(10.0), F.lit(10.5))).first()[0]
    assert not spark.range(1).select(G.next_stim_veto(F.lit(10.0), F.lit(None).cast("double"))).first()[0]


def test_windows(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(12)], "chan int, i int, x double")
    assert G.tumble(df, 5).agg(F.max("win")).first()[0] == 1
    assert [G.window_samples(0.02, r) for r in (256, 500, 512, 1000, 1024, 2048)] == [5, 10, 10, 20, 20, 41]
    holed = spark.createDataFrame([(1, 0, None), (1, 0, 2.0), (1, 0, 4.0), (1, 1, None)], "chan int, win int, x double")
    assert sorted(r[0] for r in G.fill_demean(holed).select("demeaned").collect()) == [-1.0, 0.0, 0.0, 1.0]


def test_roc(spark):
    df = spark.createDataFrame([(True, 3.0), (True, 2.0), (False, 2.0), (False, 1.0)], "y boolean, s double")
    h = V.histogram(df, F.col("y"), F.col("s"))
    assert V.roc_auc(h).first()["auc"] == 0.875
    assert V.best_threshold(h).first()["threshold"] == 1.0
    r = V.at_specificity(h, 0.9).first()
    assert (r["threshold"], r["sens"], r["spec"]) == (2.0, 0.5, 1.0)
    one = df.where("y")
    assert V.roc_auc(V.histogram(one, F.col("y"), F.col("s"))).first()["auc"] is None


def test_exclusions_and_empty_rates(spark):
    df = spark.createDataFrame([(True, 1.0, 9.0, 2.0, 0.0), (True, 3.0, 5.0, 2.0, 0.0), (True, 3.0, 5.0, 2.0, 1.0), (True, None, None, 2.0, None)], "y boolean, a double, b double, s double, o double")
    assert [r[0] for r in df.select(V.evaluable(*map(F.col, "yabso"))).collect()] == [False, False, True, True]
    none = spark.createDataFrame([(False, False)], "y boolean, p boolean")
    assert V.confusion(none, F.col("y"), F.col("p")).first()["sens"] is None
    assert V.confusion(none, F.col("y"), F.col("p"), empty="zero").first()["sens"] == 0


def test_chunks_and_edf(spark):
    assert spark.range(1).select(T.samples_per_request(500.0, F.lit(130))).first()[0] == 800_000
    df = spark.createDataFrame([([3.2],), ([3.0],), ([None, 2e7],)], "s array<double>")
    assert [tuple(r) for r in df.select(*T.physical_range(F.col("s"))).collect()] == [(3.0, 4.0), (3.0, 4.0), (0.0, 9999999.0)]
    plan = T.plan_chunks(spark.createDataFrame([(1, 130, 0.0, 4000.0)], "k int, channels int, start double, end double"), 500, "k").orderBy("first_sample").collect()
    assert [(r["first_sample"], r["last_sample"]) for r in plan] == [(0, 799_999), (800_000, 1_599_999), (1_600_000, 1_999_999)]


def test_ground_truth(spark):
    old = spark.createDataFrame([("c1", "y", "1.5"), ("c2", "n", "abc")], "clip_name string, AD string, AD_onset string")
    fixed = T.repair_ground_truth(old)
    assert fixed.columns == list(T.GROUND_TRUTH)
    assert rows(fixed.select("clip_name", "AD_onset", "ad_ongoing"), "clip_name") == [("c1", 1.5, 0.0), ("c2", None, 0.0)]
    new = T.repair_ground_truth(spark.createDataFrame([("c2", "u", "2")], "clip_name string, AD string, AD_onset string"))
    assert rows(T.upsert(fixed, new).select("clip_name", "AD"), "clip_name") == [("c1", "y"), ("c2", "u")]


def test_sessions(spark, tmp_path):
    (tmp_path / "s.csv").write_text("ieeg_name,Modifier,start,xEnd,obv_sz,obv_ad,notes\nA,1,10,20.5,x,1,\nB,2,0,5,,,hm\n")
    got = T.read_sessions(spark, str(tmp_path / "s.csv"))
    assert rows(got.select("ieeg_name", "Modifier", "end"), "ieeg_name") == [("A", 1, 20.5), ("B", 2, 5.0)]


def test_span_join(spark):
    p = spark.createDataFrame([(1, float(t)) for t in (0, 17.0, 17.01, 40)], "rec int, t double")
    s = spark.createDataFrame([(1, 10.0, 17.0)], "rec int, a double, b double")
    assert [r["t"] for r in P.within(p, s, ("rec",), "t", "a", "b", 5.0).collect()] == [17.0]


def hazen_by_hand(values, p):
    s = sorted(values)
    at = max(1.0, min(float(len(s)), p * len(s) + 0.5))
    low, high = s[int(at) - 1], s[min(len(s), int(at) + 1) - 1]
    return low + (high - low) * (at - int(at))


@pytest.mark.parametrize("values", [[], [2.5], [1.0, -3.0], [0.0, 0.5, 0.5, 0.5, 9.0], [float(k * k % 97) for k in range(1001)], [1.0] * 500 + [-2.0] * 3])
def test_onset_error(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "error double").repartition(3)
    got = V.onset_error(df)
    plan = got._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "median(" not in plan
    want = tuple(hazen_by_hand(values, p) if values else None for p in (0.5, 0.25, 0.75))
    assert tuple(got.select("n", "median", "q25", "q75").first()) == pytest.approx((len(values), *want))
