"""Scans over whole channels against the recurrences step by step, and the detector's plans against a state machine."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipwave.functions import dsp
from clipwave.operators import recurrence as R
from clipwave.operators import signal as G
from clipwave.operators import stimulation as D
from clipwave.streaming import channels as streamed


def channels(spark, signals):
    return spark.createDataFrame([(c, i, None if x is None else float(x)) for c, xs in signals.items() for i, x in enumerate(xs)], "chan long, i long, x double").repartition(5)


def by_channel(df, column):
    out = {}
    for r in df.collect():
        out.setdefault(r["chan"], {})[r["i"]] = r[column]
    return {c: [v[i] for i in range(len(v))] for c, v in out.items()}


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(4)
    return {1: rng.normal(size=700), 2: rng.normal(size=1), 3: [None, *rng.normal(size=50), None, 5.0], 4: np.zeros(9), 5: [1e6, *np.zeros(300)]}


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_leaky_mean_carries_its_state(spark, signals, block):
    got = by_channel(R.leaky_mean(channels(spark, signals), 0.99, ("chan",), "i", "x", block), "mean")
    for c, xs in signals.items():
        y, want = 0.0, []
        for x in xs:
            y = 0.99 * y + 0.01 * (x or 0.0)
            want.append(y)
        assert got[c] == pytest.approx(want, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("block", [1, 7, 64])
@pytest.mark.parametrize("decay", [0.3, 1e-3])
def test_decaying_buffer(spark, signals, block, decay):
    got = by_channel(R.decaying(channels(spark, signals), decay, ("chan",), "i", "x", block), "buffer")
    for c, xs in signals.items():
        y, want = 0.0, []
        for x in xs:
            y = decay * y + (x or 0.0)
            want.append(y)
        assert got[c] == pytest.approx(want, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("block", [1, 7, 64, 256])
@pytest.mark.parametrize("cascade", ["band", "notch", "both"])
def test_filters(spark, signals, block, cascade):
    band, notch = dsp.butter_band(4, 1, 50, 512), dsp.butter_band(2, 58, 62, 512, stop=True)
    sections = {"band": band, "notch": notch, "both": np.concatenate([band, notch])}[cascade]
    got = by_channel(R.filtered(channels(spark, signals), sections, ("chan",), "i", "x", block=block), "filtered")
    for c, xs in signals.items():
        want = dsp.run_sections(sections, np.array([x or 0.0 for x in xs])[:, None])[:, 0]
        assert np.allclose(got[c], want, rtol=1e-8, atol=1e-9 * max(1.0, np.abs(want).max()))


def test_an_index_that_begins_anywhere_and_columns_that_clash(spark):
    rows = channels(spark, {1: range(100)}).withColumn("i", F.col("i") + 37).withColumn("mean", F.lit("q"))
    got = {r["i"]: r["high"] for r in R.leaky_mean(rows, 0.5, ("chan",), "i", "x", 8).collect()}
    y = 0.0
    for x in range(100):
        y = 0.5 * y + 0.5 * x
        assert got[x + 37] == pytest.approx(x - y)
    assert R.leaky_mean(rows.limit(0), 0.5, ("chan",), "i", "x").count() == 0


@pytest.mark.parametrize("order, low, high", [(1, 5, 30), (3, 5, 30), (4, 1, 50), (3, 20, 22)])
def test_band_pass_of_any_order(order, low, high):
    sections = dsp.butter_band(order, low, high, 200)
    at = lambda f: abs(np.prod([np.polyval(r[:3], np.exp(2j * np.pi * f / 200)) / np.polyval([1, *r[3:]], np.exp(2j * np.pi * f / 200)) for r in sections]))
    assert len(sections) == order and at(low) == pytest.approx(2**-0.5, abs=1e-6) and at(high) == pytest.approx(2**-0.5, abs=1e-6)
    direct, poles, weights = dsp.parallel_form(sections)
    z = np.exp(2j * np.pi * 17 / 200)
    total = direct + sum(w / (1 - p / z) + (np.conj(w) / (1 - np.conj(p) / z) if p.imag else 0) for p, w in zip(poles, weights))
    assert abs(total) == pytest.approx(at(17), rel=1e-6)


@pytest.mark.parametrize("n", [1, 2, 5, 64, 65])
def test_band_energy_of_arrays(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([([float(v) for v in x],)], "s array<double>")
    for low, high in ((0, 100), (10, 40), (90, 100), (3, 4)):
        got = df.select(G.band_energy_of(F.col("s"), 200.0, low, high)).first()[0]
        assert got == (None if n == 1 else pytest.approx(float(dsp.band_energy(x, 200.0, low, high)), rel=1e-9, abs=1e-12))


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_counter_does_not_fall_below_zero(spark, block):
    random.seed(block)
    rows = {c: [random.choice([0, 0, 0, 1, 3, None]) for _ in range(n)] for c, n in ((1, 300), (2, 1), (3, 40))}
    df = spark.createDataFrame([(c, i, x) for c, xs in rows.items() for i, x in enumerate(xs)], "chan long, i long, over long").repartition(5)
    got = by_channel(R.bad_counter(df, "over", ("chan",), "i", every=4, less=5, block=block), "counter")
    for c, xs in rows.items():
        n, want = 0, []
        for i, x in enumerate(xs):
            n = max(0, n - (5 if (i + 1) % 4 == 0 else 0)) + (x or 0)
            want.append(n)
        assert got[c] == want


def machine(rows, rule):
    """The detector on one channel, row by row: its log, and baseline and votes of each row."""
    is_on, votes, last_on, ended, stim, told = False, [], None, None, 0, False
    quiet, base, saturated, history, log, states = [0.0] * rule.baseline_rows, None, None, [], [], []
    for i, (t, p) in enumerate(rows):
        p = 0.0 if p is None else p
        look, was_on = not is_on and ended is not None and t <= ended + rule.look_seconds, is_on
        if is_on:
            if p < rule.off:
                is_on, ended = False, t
                log.append(("stim_off", i, stim))
        else:
            votes = [*votes, p > rule.on][-rule.vote_rows :]
            if sum(votes) >= rule.vote_least and (last_on is None or t > last_on + rule.separation_seconds):
                is_on, votes, last_on, stim, told = True, [], t, stim + 1, False
                base = sum(quiet[: rule.baseline_kept]) / rule.baseline_kept
                log.append(("stim_on", i, stim))
            quiet = [*quiet[1:], p]
        ratio = None
        if (was_on or look) and base is not None and (base or p):
            ratio = p / base if base else float("inf")
        saturated = t if ratio is not None and ratio > rule.saturation else saturated
        above = ratio is not None and rule.ratio < ratio < rule.saturation and not (saturated is not None and t - saturated < rule.cool_seconds)
        history = [*history, above][-rule.history_rows :] if look else []
        if look and sum(history) >= rule.history_least and not told:
            told = True
            log.append(("ad", i, stim))
        states.append((base, sum(history)))
    return log, states


@pytest.mark.parametrize("seed", range(3))
def test_detector_equals_a_state_machine(spark, seed):
    rng = random.Random(seed)
    rule = D.Rule(on=5.0, off=2.0, vote_rows=6, vote_least=3, separation_seconds=rng.choice([0.0, 3.5, 12.0]), baseline_rows=8, baseline_kept=4, look_seconds=9.0, ratio=1.5, saturation=20.0, cool_seconds=2.5, history_rows=5, history_least=2)
    data = {}
    for c in range(12):
        t, rows = 0.0, []
        for _ in range(rng.choice([0, 1, 5, 150, 400])):
            t += rng.choice([0.5, 1.0, 2.0, 0.0])
            rows.append((t, rng.choice([None, 0.0, 1.0, 1.5, 3.0, 6.0, 7.0, 8.0, 30.0])))
        data[c] = rows
    data[90] = [(float(i), 9.0) for i in range(50)]  # never ends
    data[91] = [(float(i), 9.0 if i % 9 < 4 else 0.5) for i in range(300)]  # many
    df = spark.createDataFrame([(c, i, t, p) for c, rows in data.items() for i, (t, p) in enumerate(rows)], "chan long, i long, t double, power double").repartition(5)
    got = {c: [] for c in data}
    for r in D.event_log(df, rule).collect():
        got[r["chan"]].append((r["kind"], r["i"], r["stim"]))
    found = D.stimulations(df, rule)
    states = {c: {} for c in data}
    for r in D.detector_rows(df, found, rule).collect():
        states[r["chan"]][r["i"]] = (r["baseline"], r["votes"])
    for c, rows in data.items():
        log, want = machine(rows, rule)
        assert sorted(got[c]) == sorted(log), c
        assert [v for _, v in want] == [states[c][i][1] for i in range(len(rows))]
        assert [b for b, _ in want] == pytest.approx([states[c][i][0] for i in range(len(rows))], abs=1e-9)
    assert sum(len(machine(r, rule)[0]) for r in data.values()) > 30
    assert D.event_log(df.limit(0), rule).count() == 0


def windows(spark, data):
    rows = [(c, i, float(t), p) for c, xs in data.items() for i, (t, p) in enumerate(xs)]
    return spark.createDataFrame(rows, "chan long, event_id long, t double, power double").withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1000000).cast("long")))


RULE = D.Rule(on=5.0, off=2.0, vote_rows=6, vote_least=3, separation_seconds=3.5, baseline_rows=8, baseline_kept=4, look_seconds=9.0, ratio=1.5, saturation=20.0, cool_seconds=2.5, history_rows=5, history_least=2)


def some_channels():
    rng, data = random.Random(11), {}
    for c in range(5):
        t, rows = 1000.0 * c, []
        for _ in range(120):
            t += rng.choice([0.5, 1.0, 20.0])
            rows.append((t, rng.choice([None, 0.0, 1.0, 1.5, 3.0, 6.0, 7.0, 30.0])))
        data[c] = rows
    return data


def logs(df):
    return sorted((r["chan"], r["kind"], r["i"], r["stim"]) for r in df.collect())


def test_stream_equals_state_machine(spark):
    data = some_channels()
    want = sorted((c, k, i, s) for c, rows in data.items() for k, i, s in machine(rows, RULE)[0])
    rows = windows(spark, data)
    assert len(want) > 20 and logs(streamed.replay(rows, RULE)) == want
    assert streamed.replay(rows.limit(0), RULE).count() == 0


def test_stream_counts_rows_once_that_come_in_two_batches(spark, tmp_path):
    """A second batch that begins with the first's first row doesn't take the place of the first."""
    data = some_channels()
    want = sorted((c, k, i, s) for c, rows in data.items() for k, i, s in machine(rows, RULE)[0])
    rows = windows(spark, data)
    source, log, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    for some in (rows, rows.where("event_id % 3 = 0"), windows(spark, {99: [(1e6, 0.0)]}), windows(spark, {99: [(2e6, 0.0)]})):
        some.coalesce(1).write.mode("append").parquet(source)
        streamed.run(source, rows.schema, RULE, log, checkpoint, spark, "10000 seconds")
    assert logs(spark.read.schema(streamed.EVENT).parquet(log)) == want


def test_stream_keeps_few_states_for_many_channels(spark, tmp_path):
    """Each call for a state costs about a millisecond: a bucket's channels share them."""
    rows = windows(spark, {c: [(float(i), 9.0 if i < 4 else 0.5) for i in range(8)] for c in range(300)})
    log, checkpoint = (f"file://{tmp_path}/{n}" for n in ("out", "state"))
    for some in (rows, windows(spark, {999: [(1e6, 0.0)]})):
        some.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        streamed.run(f"file://{tmp_path}/in", rows.schema, RULE, log, checkpoint, spark, buckets=8)
    states = spark.read.format("statestore").option("stateVarName", "states").load(checkpoint)
    found = logs(spark.read.schema(streamed.EVENT).parquet(log))
    assert len(found) == 300 * len(machine([(float(i), 9.0 if i < 4 else 0.5) for i in range(8)], RULE)[0])
    assert 0 < states.count() <= 8


def test_stream_goes_on_from_its_checkpoint_and_drops_late_rows(spark, tmp_path):
    data = some_channels()
    want = sorted((c, k, i, s) for c, rows in data.items() for k, i, s in machine(rows, RULE)[0])
    rows = windows(spark, data)
    source, log, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    take = lambda df: df.coalesce(1).write.mode("append").parquet(source)
    run = lambda: streamed.run(source, rows.schema, RULE, log, checkpoint, spark, "100 seconds")
    take(rows.where("t < 2000"))
    run()
    first = logs(spark.read.schema(streamed.EVENT).parquet(log))
    assert 0 < len(first) < len(want)
    take(rows.where("t >= 2000"))
    run()
    # Behind the watermark by now: it would be the first row of a new channel.
    take(windows(spark, {0: [(5.0, 100.0)]}))
    run()
    take(windows(spark, {99: [(1e6, 0.0)]}))
    run()
    assert logs(spark.read.schema(streamed.EVENT).parquet(log)) == want
