"""Every query against the same rows from DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from clipwave.plans import catalogue

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = f"{DATA}/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    want = duck.sql(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({catalogue.oracle_sql()[name]})").fetchall()
    assert plain(map(tuple, df.select(*(f"`{c}`" for c in cols)).collect())) == plain(want)


def test_every_recording_gets_a_plan(spark):
    orders = {r["o_orderkey"]: r for r in spark.read.parquet(f"{DIR}/orders.parquet").collect()}
    plan = {}
    for r in catalogue.queries()["chunk_planner"](spark, DIR).collect():
        plan.setdefault(r["o_orderkey"], []).append((r["first_sample"], r["last_sample"]))
    assert set(plan) == set(orders)
    for key, parts in plan.items():
        parts.sort()
        assert all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
        start = orders[key]["o_totalprice"] / 1000
        assert (parts[0][0], parts[-1][1]) == (int(start * 500 + 0.5), int((start + 600) * 500 + 0.5) - 1)


def test_every_sample_is_filtered(spark):
    want = {}
    for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect():
        y = 0.0
        for k, x in enumerate(r["embedding"], 1):
            y = 0.99 * y + 0.01 * x
            want[r["vec_id"], k] = x - y
    got = {(r["vec_id"], r["k"]): r["high"] for r in catalogue.queries()["leaky_highpass"](spark, DIR).collect()}
    assert got == pytest.approx(want, abs=1e-8)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_clip_validation(spark):
    """The study's row from its own features, by brute force."""
    rows = [r for r in catalogue.annotated_features(spark, DIR).collect() if r["evaluable"]]
    least = min(r["score"] for r in rows if r["score"] > float("-inf")) - 1
    score = lambda r: max(r["score"], least)

    def rates(some, t):
        pos, neg = [r for r in some if r["truth"]], [r for r in some if not r["truth"]]
        return sum(score(r) > t for r in pos) / len(pos), sum(score(r) <= t for r in neg) / len(neg)

    def chosen(some):
        found = sorted({score(r) for r in some})
        return max([found[0] - 1, *found], key=lambda t: (round(sum(rates(some, t)), 12), -t))

    patients = sorted({r["patient"] for r in rows})
    at = {p: chosen([r for r in rows if r["patient"] != p]) for p in patients}
    hit = lambda r: r["score"] > at[r["patient"]]
    got = catalogue.queries()["clip_validation"](spark, DIR).first()
    assert (got["tp"], got["fn"]) == (sum(r["truth"] and hit(r) for r in rows), sum(r["truth"] and not hit(r) for r in rows))
    assert (got["fp"], got["tn"]) == (sum(not r["truth"] and hit(r) for r in rows), sum(not r["truth"] and not hit(r) for r in rows))
    minutes = sum(r["minutes"] for r in rows if not r["truth"])
    assert got["minutes"] == pytest.approx(minutes) and got["fp_per_min"] == pytest.approx(got["fp"] / minutes)
    pos, neg = [score(r) for r in rows if r["truth"]], [score(r) for r in rows if not r["truth"]]
    assert got["auc"] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    late = sorted(r["onset"] - r["AD_onset"] for r in rows if r["truth"] and hit(r))
    assert got["onset_median"] == pytest.approx((late[(len(late) - 1) // 2] + late[len(late) // 2]) / 2)
    fit = [t for t in [least - 1, least, *{score(r) for r in rows}] if rates(rows, t)[1] >= 0.9]
    assert got["sens_at_spec"] == pytest.approx(max(rates(rows, t)[0] for t in fit))


def same_as_sql(spark, folder, name, **tables):
    """The query's rows and its SQL's, exactly, on tables of one's own."""
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    want = con.sql(f"select {', '.join(df.columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
    assert len(want) and sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_discharges_of_just_the_least_length_count(spark, tmp_path):
    """A length of 3 seconds isn't under 3, whatever the onset."""
    docs = spark.range(500).selectExpr("id as doc_id", "'web' as source", "id * 97 + 3 as n_chars")
    labels = spark.range(500).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    same_as_sql(spark, tmp_path, "classify_trials", documents=docs, labels=labels)


def test_ratios_halfway_between_two_last_digits(spark, tmp_path):
    """Ratios such as 1.0355625, whose sixth digit the decimal text and the product with a million round apart."""
    rows = [(416.14, 128.0), (417.09, 64.0), (480.87, 576.0), (165.69, 1600.0), (327.0, 128.0), (1e305, 10.0)]
    values = [(u, i, {0: base, 20: x}.get(i, 0.0)) for u, (x, base) in enumerate(rows) for i in range(21)]
    e = spark.createDataFrame(values, "user_id long, i long, value double")
    events = e.selectExpr("user_id * 100 + i as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, int(i)) as ts", "user_id", "'view' as event_type", "value")
    same_as_sql(spark, tmp_path, "rolling_baseline_ratio", events=events.where("i <> 0 or value > 0"))


def test_baseline_takes_the_whole_history(spark, tmp_path):
    """The oldest 50 of the 100 events before, zeros before the first: events 0 to 49 count for event 100, event 0 alone for event 51."""
    e = spark.range(102).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, int(id)) as ts", "1L as user_id", "'view' as event_type", "cast(id + 1 as double) as value")
    same_as_sql(spark, tmp_path, "rolling_baseline_ratio", events=e)
    got = {r["event_id"]: r["ratio"] for r in catalogue.queries()["rolling_baseline_ratio"](spark, str(tmp_path)).collect()}
    assert got[50] == float("inf") and got[51] == 52 / (1 / 50)
    assert got[100] == pytest.approx(101 / 25.5, abs=1e-6) and got[101] == pytest.approx(102 / 26.5, abs=1e-6)


def test_ratios_halfway_of_the_whole_history(spark, tmp_path):
    """As above, over a baseline of 50 of 100 events whose sum is exact."""
    rows = [(416.14, 640.0), (417.09, 320.0), (480.87, 2880.0), (165.69, 8000.0), (327.0, 640.0)]
    values = [(u, i, {0: base, 100: x}.get(i, 0.0)) for u, (x, base) in enumerate(rows) for i in range(101)]
    e = spark.createDataFrame(values, "user_id long, i long, value double")
    events = e.selectExpr("user_id * 1000 + i as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, int(i)) as ts", "user_id", "'view' as event_type", "value")
    same_as_sql(spark, tmp_path, "rolling_baseline_ratio", events=events)
    got = {r["event_id"]: r["ratio"] for r in catalogue.queries()["rolling_baseline_ratio"](spark, str(tmp_path)).collect()}
    assert all(abs(got[u * 1000 + 100] - 50 * x / base) < 1e-6 for u, (x, base) in enumerate(rows))
