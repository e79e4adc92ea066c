"""Stored segments, searches that end early, and upserts that can be repeated."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipwave.operators import stimulation as D
from clipwave.sources import eeg
from clipwave.sources import files as W
from clipwave.sources import segments as X
from clipwave.streaming import annotations as A
from clipwave.streaming import queries as Q

from .conftest import DATA
from .test_recurrence import RULE, machine


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = random.Random(3)
    data = {(s, c, i): float(rng.randint(0, 99)) for s in (1, 2, 3) for c in range(3) for i in range(200) if (s, i // 20) != (2, 4)}
    path = f"file://{tmp_path_factory.mktemp('store')}/segments"
    rows = spark.createDataFrame([(*k, x) for k, x in data.items()] + [(1, 0, 0, 1000.0)], "session int, chan long, i long, x double").repartition(5)
    X.write_segments(X.segments(rows, 16), path, 64)
    return path, data


def samples_of(df, *keys):
    return {(*(r[k] for k in keys), r["session"], r["chan"], r["first_sample"] + k): x for r in df.collect() for k, x in enumerate(r["samples"]) if x is not None}


def test_ranges_include_both_ends(spark, store):
    path, data = store
    ranges = [(0, 1, 0, 0), (1, 1, 63, 64), (2, 2, 70, 110), (3, 3, 190, 500), (4, 9, 0, 10), (5, 2, 10, 5), (6, 1, 30, 180)]
    asked = spark.createDataFrame(ranges, "range int, session int, first long, last long")
    want = {(r, s, c, i): x for r, session, a, b in ranges for (s, c, i), x in data.items() if s == session and a <= i <= b}
    assert samples_of(X.read_ranges(spark, path, asked, 64), "range") == want
    one = samples_of(X.read_range(spark, path, 1, 30, 180, [0, 2], 64))
    assert one == {(s, c, i): x for (s, c, i), x in data.items() if s == 1 and 30 <= i <= 180 and c != 1}


def test_ranges_read_their_folders_alone(spark, store):
    path, _ = store
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = X.read_range(spark, path, 1, 30, 100, [0], 64)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session" in plan and "stretch" in plan.split("PartitionFilters: ")[1].split("]")[0]
    pushed = plan.split("PushedFilters: ")[1].split("]")[0]
    assert "LessThanOrEqual(first_sample,100)" in pushed and "GreaterThanOrEqual(last_sample,30)" in pushed and "chan" in pushed
    ranges = spark.createDataFrame([(0, 1, 0, 20), (1, 2, 0, 20)], "range int, session int, first long, last long")
    asked = ranges.where("range = 0")
    df = X.read_ranges(spark, path, asked, 64)
    assert "dynamicpruning" in df._jdf.queryExecution().optimizedPlan().toString().lower() or "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString().lower()
    assert {(r["session"], r["stretch"]) for r in spark.read.parquet(path).select("session", "stretch").distinct().collect()} == {(s, k) for s in (1, 2, 3) for k in range(4)}


def test_search_ends_early(spark):
    rng, data = random.Random(2), {}
    for c in range(8):
        data[c] = [(float(i), rng.choice([0.0, 1.0, 7.0, 8.0]) if c % 3 else (9.0 if i % 9 < 4 else 0.5)) for i in range(rng.choice([40, 400]))]
    data[50] = [(float(i), 1.0) for i in range(400)]
    df = spark.createDataFrame([(c, i, t, p) for c, rows in data.items() for i, (t, p) in enumerate(rows)], "chan long, i long, t double, power double")
    want = []
    for c, rows in data.items():
        found = []
        for k in range(0, 400, 50):
            part = [r for r in rows if k <= r[0] < k + 50]
            log = sorted(e[1:] + (e[0],) for e in machine(part, RULE)[0] if e[0] != "ad")
            for j, (i, _, kind) in enumerate(log):
                if kind == "stim_on":
                    off = part[log[j + 1][0]][0] if j + 1 < len(log) else part[-1][0]
                    found.append((part[i][0], off))
        want += [(c, k, on, off, off - on) for k, (on, off) in enumerate(found[:3], 1)]
    read = []
    got = [tuple(r) for r in D.first_stimulations(df, RULE, 3, 50.0, read=read).collect()]
    assert sorted(got) == sorted(want) and want
    assert sum(read) < sum(map(len, data.values()))
    assert D.first_stimulations(df.limit(0), RULE, 3, 50.0).count() == 0


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/versions"
    write = A.upsert_batch(path, ("clip",), "turn")
    rows = lambda *r: spark.createDataFrame(r, "clip string, AD string, turn long")
    now = lambda: sorted(tuple(r) for r in A.current(spark, path, ("clip",), "turn").select("clip", "AD", "turn").collect())
    write(rows(("a", "y", 1), ("b", "n", 2), ("a", "n", 3)), 0)
    write(rows(("b", "y", 4), ("c", None, 5)), 1)
    want = [("a", "n", 3), ("b", "y", 4), ("c", None, 5)]
    assert now() == want
    write(rows(("a", "y", 1), ("b", "n", 2), ("a", "n", 3)), 0)
    assert now() == want
    write(rows(("a", "u", 3)), 2)  # the same turn, told later
    write(rows(("c", "y", 2)), 3)  # older than what is there
    want = [("a", "u", 3), ("b", "y", 4), ("c", None, 5)]
    assert now() == want
    A.compact(spark, path, f"file://{tmp_path}/compact", ("clip",), "turn")
    assert sorted(tuple(r) for r in A.current(spark, f"file://{tmp_path}/compact", ("clip",), "turn").select("clip", "AD", "turn").collect()) == want


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    source, path, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "versions", "state"))
    take = lambda *r: spark.createDataFrame(r, "clip string, AD string, turn long").coalesce(1).write.mode("append").parquet(source)
    take(("a", "y", 1))
    stream = lambda: spark.readStream.schema("clip string, AD string, turn long").parquet(source)
    A.follow(stream(), path, checkpoint, ("clip",), "turn")
    take(("a", "n", 2), ("b", "y", 3))
    A.follow(stream(), path, checkpoint, ("clip",), "turn")
    A.follow(stream(), path, checkpoint, ("clip",), "turn")
    found = A.current(spark, path, ("clip",), "turn")
    assert sorted(map(tuple, found.select("clip", "AD").collect())) == [("a", "n"), ("b", "y")]
    assert spark.read.parquet(path).agg(F.countDistinct("version")).first()[0] == 2


def test_files_of_vectors(spark):
    clips = {}
    for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect():
        clips.setdefault(f"clip{r['vec_id'] // 8}", {})[r["vec_id"] % 8] = r["embedding"]
    want = {}
    for clip, channels in clips.items():
        raw = eeg.edf_bytes([f"LA{c + 1}" for c in sorted(channels)], 64.0, np.array([channels[c] for c in sorted(channels)]).T)
        want[clip] = (len(raw), hashlib.sha256(raw).hexdigest())
    for query in (Q.edf_files, Q.edf_export):
        found = query(spark, f"{DATA}/sf0.001").collect()
        assert {r["clip"]: (r["n_bytes"], r["sha256"]) for r in found} == want and len(found) == len(want)


def test_files_are_committed_together(spark, tmp_path):
    path = f"file://{tmp_path}/files"
    rows = lambda *r: spark.createDataFrame(r, "name string, content binary").repartition(3)
    held = lambda: {r["name"]: None if r["content"] is None else bytes(r["content"]) for r in W.read_files(spark, path).collect()}
    assert held() == {}
    W.write_files(rows(("a.edf", b"1"), ("s1/b.edf", b"\0\xff"), ("s1/empty.edf", None)), path)
    assert held() == {"a.edf": b"1", "s1/b.edf": b"\0\xff", "s1/empty.edf": b""}
    with pytest.raises(Exception, match="not a name"):
        W.write_files(rows(*((f"c{i}.edf", b"2") for i in range(20)), ("../out", b"3")), path)
    assert len(held()) == 3 and not (tmp_path / "files" / "out").exists()
    data = tmp_path / "files" / "data"
    assert sum(len([f for f in d.rglob("*") if f.is_file()]) for d in data.iterdir()) == 3  # the failed write left nothing
    # A folder that no manifest names, as of a task whose executor was lost.
    (data / "lost").mkdir()
    (data / "lost" / "d.edf").write_bytes(b"4")
    assert len(held()) == 3
    W.write_files(W.new_only(rows(("a.edf", b"other"), ("e.edf", b"5")), path), path)
    assert held() == {"a.edf": b"1", "s1/b.edf": b"\0\xff", "s1/empty.edf": b"", "e.edf": b"5"}
    W.write_files(rows(("x", b"")).limit(0), path)
    assert {r["content"] for r in W.read_files(spark, path, content=False).collect()} == {None} and len(held()) == 4
