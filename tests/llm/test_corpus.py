"""Operators over many rows: against brute force."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from clipwave.llm import bpe, common, components, gam, jaccard, kdsearch, langid, mixing, queries, sharding, stages

from ..conftest import DATA

DIR = f"{DATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, n string, c string, shard string, kept string"


def table(spark, texts):
    """Texts, or (doc_id, text) pairs, with clashing columns."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z", "u", "v") for i, t in rows], SCHEMA)


def word_set(text):
    w = [x for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    """Smallest reachable id of every id, over rows of (id, set); rows of one id belong together."""
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def copies(seed, groups=12, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, words))]
        if g % 3 == 0:
            base += passage
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    return texts


def check_join(spark, rows):
    got = [tuple(r) for r in jaccard.join(table(spark, rows)).collect()]
    pairs = [(i, word_set(t)) for i, t in rows if i is not None]
    want = brute_components(pairs)
    assert len(got) == len(rows)
    assert Counter(got) == Counter((i, len(word_set(t)), want[i] if i is not None else None) for i, t in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_join_like_brute_force(spark, seed):
    texts = copies(seed)
    random.Random(seed).shuffle(texts)
    check_join(spark, [*enumerate(texts), (900, None), (901, " \n"), (902, "one"), (903, "ONE"), (904, "one two"), (None, "one"), (905, "x " * 200), (906, "X  x " * 100)])


def test_join_with_repeated_keys(spark):
    a, b, c = ("one two three four five six seven " * 1, "alpha beta gamma delta epsilon zeta", "red green blue black white grey")
    rows = [(7, a), (7, b), (3, a), (5, b), (5, b), (9, c)]
    got = {tuple(r) for r in jaccard.join(table(spark, rows)).collect()}
    assert got == {(7, 3, 3), (7, 2, 3), (3, 3, 3), (5, 2, 3), (9, 2, 9)}


def test_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TASK", 300)
    monkeypatch.setattr(jaccard, "BUCKET", 500)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(t))
    check_join(spark, [*enumerate(texts)])


def test_search_of_one_large_group(spark, monkeypatch):
    """Chains, clusters and lone sets in one group of many blocks: what representatives don't show, the rest finds; every edge is right."""
    monkeypatch.setattr(jaccard, "ROWS", 7)
    rng = np.random.default_rng(3)
    sets = []
    for chain in range(5):
        now = rng.choice(10_000, 40, replace=False) + 10_000 * chain
        for _ in range((40, 12, 6, 2, 1)[chain]):
            now = now.copy()
            now[rng.integers(0, 40, 4)] = rng.integers(100_000, 1_000_000, 4)
            sets.append(sorted({int(x) for x in now}))
    rows = [(k, k + 1, len(s), s) for k, s in enumerate(sets)]
    held = spark.createDataFrame(rows, "node long, c long, n long, s array<long>")
    edges = [tuple(r) for r in jaccard.search(held, held.select("node", F.lit(0).cast("long").alias("component"))).collect()]
    want = brute_components([(k, set(s)) for k, s in enumerate(sets)])
    assert len(set(want.values())) == 5
    found = {k: k for k in range(len(sets))}
    for _ in sets:
        for a, b in edges:
            found[a] = found[b] = min(found[a], found[b])
    assert found == want


def test_trees_join_what_links_join():
    """Also where a node has several places, and so may be in several trees."""
    assert jaccard.trees([], [3, 1]) == []
    assert jaccard.trees([(0, 1), (2, 3)], [5, 1, 5, 2]) == [(5, 1), (5, 2)]
    rng = random.Random(4)

    def joined(pairs):
        up = {k: k for k in range(9)}
        for _ in range(9):
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
        return up

    for _ in range(300):
        nodes = [rng.randrange(9) for _ in range(rng.randint(1, 9))]
        links = [(rng.randrange(len(nodes)), rng.randrange(len(nodes))) for _ in range(rng.randint(0, 8))]
        found = jaccard.trees(links, nodes)
        assert all(a > b for a, b in found)
        assert joined(found) == joined([(nodes[x], nodes[y]) for x, y in links])


def test_join_empty(spark):
    assert jaccard.join(table(spark, [])).count() == 0


def test_shingles_of_a_batch():
    """Texts are hashed together, in any slice of a column, and no shingle reaches from one into the next."""
    texts = [None, "", " \n", "a", "A", "a b c d e", "A  b\x0bC d\te", "x " * 300, "a b c d", "e f g", "\x1c\x85 b c d e f", "y" * 64, "y" * 65, "Y" * 500 + " z", *copies(3)]
    column = pa.array(["before", *texts, "behind"])
    got = jaccard.shingle_sets(column.slice(1, len(texts)))
    assert [len(s) for s in got] == [len(word_set(t)) for t in texts]
    assert all((s[1:] > s[:-1]).all() for s in got)
    same = {}
    for t, s in zip(texts, got, strict=True):
        assert same.setdefault(frozenset(word_set(t)), s.tobytes()) == s.tobytes() == jaccard.shingles(t).tobytes()
    assert len({*same.values()}) == len(same)


def test_short_lists_by_brute_force(spark, monkeypatch):
    """The n - T + 1 rarest shingles, those of one node only going first and left out; packed in many buckets."""
    monkeypatch.setattr(jaccard, "BUCKET", 90)
    rng = random.Random(6)
    sets = [{rng.randrange(-300, 300) << 54 for _ in range(rng.randint(1, 60))} for _ in range(40)]
    rows = [(k, 2 * k - 39, len(s), sorted(s, key=lambda h: h % (1 << 64))) for k, s in enumerate(sets)]
    found = jaccard.short_lists(spark.createDataFrame(rows, "node long, c long, n long, s array<long>"))
    often = Counter(h for s in sets for h in s)
    want = Counter()
    for k, s in enumerate(sets):
        rarest = sorted(s, key=lambda h: (often[h], h % (1 << 64)))[: len(s) - -(-4 * len(s) // 5) + 1]
        want.update((k, h) for h in rarest if often[h] > 1)
    assert want and Counter(map(tuple, found.collect())) == want


def test_peeling_reads_no_texts(spark):
    """What describes a document holds the hashes that peeling compares, so no text is shingled twice for it."""
    rows = jaccard.describe(table(spark, [*enumerate(["one two three four five six", "ONE two three four five six", "one two three four five seven eight", "alone"])]), "doc_id", "text")
    got = {r["c"]: r["u"] for r in jaccard.lonely(rows, "low", 4, 1 << 64).collect()}
    low = Counter(h for c, s in {r["c"]: bytes(r["low"]) for r in rows.collect()}.items() for h in np.frombuffer(s, np.uint64))
    assert "text" not in rows.columns and sum(got.values()) == sum(v == 1 for v in low.values())


def test_divide_skip_finds_every_partner():
    rng = np.random.default_rng(8)
    for _ in range(20):
        base = np.sort(rng.choice(10_000, 80, replace=False))
        sets = []
        for _ in range(25):
            s = set(base.tolist())
            for x in rng.choice(base, rng.integers(0, 12), replace=False):
                s.discard(int(x))
                s.add(int(rng.integers(20_000, 90_000)))
            sets.append(np.array(sorted(s), dtype=np.int64))
        sets.sort(key=len)
        search = jaccard.DivideSkip(sets)
        for q, a in enumerate(sets):
            want = {k for k, b in enumerate(sets) if k != q and 100 * (i := len(np.intersect1d(a, b))) >= 80 * (len(a) + len(b) - i)}
            assert set(search.partners(q, lambda _: False)) == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(40)]
    want = brute_components([(i, frozenset()) for e in edges for i in e])
    up = {i: i for i in want}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for e in edges if e[0] != e[1] for i in e}


VECTORS = "vec_id long, embedding array<float>, label int, score string"


def brute_top(rows, asked, k=5, scale=256):
    whole = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in whole:
        if asked(q):
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(b) == len(a))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("shard", [4096, 64])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(kdsearch, "SHARD_ROWS", shard)
    monkeypatch.setattr(kdsearch, "QUERY_ROWS", 7)
    monkeypatch.setattr(kdsearch, "BATCH_BLOCKS", 2)
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=6).round(1).tolist()) for i in range(300)]
    rows += [(int(i), [0.5] * 6) for i in range(300, 340)]
    rows += [(1000, None), (1001, [float("nan")] * 6), (1002, [None] * 6), (1050, [float("inf")] * 6), (None, [1.0] * 6), (1100, [1.0, 2.0]), (1101, [1.0, 2.0]), (1150, [])]
    got = {tuple(r) for r in kdsearch.top_k(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VECTORS), queries=(__import__("pyspark").sql.functions.col("vec_id") % 50 == 0)).collect()}
    assert got == brute_top(rows, lambda q: q % 50 == 0)


def test_top_k_of_large_components(spark, monkeypatch):
    monkeypatch.setattr(kdsearch, "SHARD_ROWS", 20)
    rng = random.Random(3)
    rows = [(i, [rng.choice([1e6, -1e6, 3e38, -3e38, 1e18, 0.25, -0.7, 5e8]) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [rng.uniform(-2, 2) for _ in range(4)]) for i in range(60)] + [(300, [1e6, 0.0, -1e6, 2.0]), (301, [1e6, 0.0, 1e5, 2.0])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    long = np.iinfo(np.int64)
    want = {(q, r, i, min(max(s, long.min), long.max)) for q, r, i, s in brute_top(rows, lambda q: q % 10 == 0)}
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VECTORS)
    assert {tuple(r) for r in kdsearch.top_k(df, queries=F.col("vec_id") % 10 == 0).collect()} == want


def test_top_k_of_doubles_at_the_end_of_their_range(spark):
    rows = [(1, [1.7e308]), (2, [1.6e308]), (3, [-1.7e308]), (50, [1.5e308]), (100, [-3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in kdsearch.top_k(df, queries=F.col("vec_id") % 50 == 0).collect()}
    assert got == {(50, 1, 1), (50, 2, 2), (50, 3, 100), (50, 4, 3), (100, 1, 3), (100, 2, 50), (100, 3, 2), (100, 4, 1)}


def test_top_k_query_and_empty(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    assert {tuple(r) for r in queries.op7_exact_top_k(spark, DIR).collect()} == brute_top(rows, lambda q: q % 50 == 0)
    from pyspark.sql import functions as F

    assert kdsearch.top_k(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0


def test_mixing_like_duckdb(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    df = queries.op8_source_mixing(spark, DIR)
    want = con.sql(f"select {', '.join(sorted(df.columns))} from ({mixing.oracle()})").fetchall()
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect())) == sorted(want)


def test_mixing_meets_the_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(300, 900), rng.choice(["en", "en", "en", "de"]), rng.choice("aaab"), None, "x", "y", "z", "u", "v") for i in range(3000)]
    given = {"source": {"a": 0.4, "b": 0.6}, "lang": {"en": 0.5, "de": 0.5}}
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), given, budget=0.2).where("kept").groupBy("source").sum("tokens").collect()
    share = {r[0]: r[1] for r in out}
    assert abs(share["a"] / sum(share.values()) - 0.4) < 0.06


def wanted(docs):
    """Shares of tokens by side and value: the corpus' own to the power 1/2."""
    out = {}
    for side in ("source", "lang", "topic"):
        sums = Counter()
        for r in docs:
            sums[r[side]] += r["tokens"]
        whole = sum(math.sqrt(t) for t in sums.values() if t)
        out |= {(side, v): math.sqrt(t) / whole for v, t in sums.items() if t}
    return out


def shares(docs, times):
    out, whole = Counter(), sum(r["tokens"] * r[times] for r in docs)
    for r in docs:
        for side in ("source", "lang", "topic"):
            out[side, r[side]] += r["tokens"] * r[times] / whole
    return out


def test_mixing_meets_the_targets_by_default(spark):
    docs = queries.op8_source_mixing(spark, f"{DATA}/sf0.01").collect()
    found = shares(docs, "rate")
    assert all(abs(found[k] / t - 1) < 1e-4 for k, t in wanted(docs).items())
    assert all(r["copies"] in (math.floor(r["rate"]), math.ceil(r["rate"])) for r in docs)


def test_mixing_stage_meets_the_targets_on_skewed_rows(spark):
    rng = random.Random(5)  # a hot source, a rare language that mostly another source has
    texts = {"prose": "w " * 600, "listing": "w\n" * 500, "short": "w " * 150}
    sizes = {("hot", "en"): 4000, ("hot", "de"): 100, ("b", "en"): 150, ("b", "de"): 300, ("c", "en"): 200, ("c", "de"): 250}
    kinds = [(source, lang, texts[t]) for (source, lang), n in sizes.items() for t, share in (("prose", 1), ("listing", 0.2), ("short", 0.5)) for _ in range(int(n * share))]
    rng.shuffle(kinds)
    docs = spark.createDataFrame([(i, text, lang, source, len(text)) for i, (source, lang, text) in enumerate(kinds)], "doc_id long, text string, lang string, source string, n_chars long")
    want = wanted([r.asDict() for r in mixing.mix(docs).select("source", "lang", "topic", "tokens").collect()])
    out = stages.mix(spark, docs, DIR)
    assert out.columns == docs.columns
    got = [r.asDict() | {"n": 1} for r in out.select("source", "lang", mixing.topic_of().alias("topic"), mixing.tokens_of().alias("tokens")).collect()]
    found = shares(got, "n")
    assert all(abs(found[k] / t - 1) < 0.1 for k, t in want.items()), (found, want)
    whole = sum((len(text) + 3) // 4 for _, _, text in kinds)
    assert abs(sum(r["tokens"] for r in got) / whole - 1) < 0.05


@pytest.mark.parametrize("few", [0, 50_000])
def test_raking_says_how_far_it_is(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    cells = spark.createDataFrame([("a", "en", "x", 60), ("a", "de", "x", 20), ("b", "en", "x", 20), ("b", "fr", "x", 5)], "source string, lang string, topic string, tokens long")
    out = mixing.calibrate(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "de": 0.2, "fr": 0.2}}).collect()
    assert all(r["off"] <= mixing.TOLERANCE for r in out)
    assert abs(sum(r["weight"] for r in out if r["source"] == "a") - 0.5) < 1e-4 and abs(sum(r["weight"] for r in out if r["lang"] == "en") - 0.6) < 1e-4
    never = mixing.calibrate(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.1, "fr": 0.8}}, rounds=5).collect()
    assert never[0]["off"] > 0.1


def test_mixing_leaves_other_columns(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "s", "mine", "too", "there")], "doc_id long, text string, lang string, source string, m_source string, m_lang string, away string")
    out = mixing.mix(docs).first()
    assert (out["m_source"], out["m_lang"], out["away"]) == ("mine", "too", "there")


def test_mixing_edges(spark):
    odd = table(spark, [(0, None), (1, ""), (2, "word"), (2, "word"), (None, "x" * 100_000)])
    out = mixing.mix(odd).collect()
    assert len(out) == 5 and all(0 <= r["probability"] <= 1 for r in out)
    assert mixing.mix(table(spark, [])).count() == 0


def check_shards(rows, found, shards):
    sizes = {}
    for r in found:
        sizes.setdefault(r["shard"], []).append(r)
    assert len(found) == len(rows) and all(0 <= s < shards for s in sizes)
    for some in sizes.values():
        assert sorted(r["slot"] for r in some) == list(range(len(some)))
    text = dict(rows)
    for r in found:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    return {s: sum(r["size"] for r in some) for s, some in sizes.items()}


def assert_texts_together(found):
    where = {}
    for r in found:
        where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def largest_text(found):
    """Bytes of all rows of the text that has most: what may lie on the wrong side of a cut, as texts aren't cut apart."""
    sizes = Counter()
    for r in found:
        sizes[r["text_crc32"], r["size"]] += r["size"]
    return max(sizes.values())


def test_shards(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["é", "word ", "x"]) * rng.randint(0, 200)) for i in range(3000)] + [(i, "the same text " * 5) for i in range(3000, 4500)] + [(9999, None)]
    rng.shuffle(rows)
    found = sharding.shard(table(spark, rows), 24).collect()
    sizes = check_shards(rows, found, 24)
    assert_texts_together(found)
    copies = sizes.pop(next(r["shard"] for r in found if r["doc_id"] == 3000))  # over a shard: they have one of their own
    assert copies == 1500 * 78
    mean = sum(sizes.values()) / 23
    assert len(sizes) == 23 and all(abs(s - mean) <= 0.02 * mean + largest_text(r for r in found if r["doc_id"] < 3000) for s in sizes.values())
    for n in (1, 5):
        assert len(check_shards(rows, sharding.shard(table(spark, rows), n).collect(), n)) == n


def test_copies_stay_together(spark):
    rows = [(i, f"text {i // 3} " * 20) for i in range(3000)]
    found = sharding.shard(table(spark, rows), 8).collect()
    where = {}
    for r in found:
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_several_heavy_texts(spark):
    """Texts over the share of what is left, though not over the share of all."""
    rows = [(i, "a" * 992) for i in range(600)] + [(1000 + i, "b" * 992) for i in range(60)] + [(2000 + i, "c" * 392 + str(i)) for i in range(100)]
    found = sharding.shard(table(spark, rows), 6).collect()
    sizes = check_shards(rows, found, 6)
    assert_texts_together(found)
    assert sorted(sizes.values())[-2:] == [60_000, 600_000] and max(sorted(sizes.values())[:4]) < 1.1 * min(sizes.values())
    assert len(check_shards(rows[:600], sharding.shard(table(spark, rows[:600]), 6).collect(), 6)) == 1


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_shards_query_keeps_equal_texts_together(spark, sf):
    found = queries.op10_kd_shards(spark, f"{DATA}/{sf}").collect()
    assert_texts_together(found)
    assert len({r["shard"] for r in found}) == 24


def test_shards_query(spark):
    d = f"{DATA}/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    found = queries.op10_kd_shards(spark, d).collect()
    sizes = check_shards(rows, found, 24)
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None} and len(sizes) == 24
    longest, mean = max(r["size"] for r in found), sum(sizes.values()) / 24
    assert all(abs(s - mean) <= 0.02 * mean + longest for s in sizes.values())


def test_splits_are_on_metadata(spark):
    tree = []
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    sizes = [r["sum(size)"] for r in sharding.shard(docs, 24, tree=tree).groupBy("shard").sum("size").collect()]
    mean = sum(sizes) / 24
    assert max(sizes) < 1.02 * mean and min(sizes) > 0.98 * mean  # one text is up to an eighth of a shard here
    assert len(tree) == 23 and not any("crc" in d or "text" in d for d in sharding.DIMENSIONS)
    used = {sharding.DIMENSIONS[n["axis"]] for n in tree}
    assert len(used) >= 3, used
    assert all(n["wide"][n["axis"]] >= max(n["wide"]) - 1e-9 for n in tree)


def test_shards_of_target_bytes(spark):
    rng = random.Random(8)
    rows = [(i, "word " * rng.randint(0, 300)) for i in range(2000)]
    found = sharding.shard(table(spark, rows), target_bytes=50_000).collect()
    total = sum(r["size"] for r in found)
    sizes = check_shards(rows, found, -(-total // 50_000))
    assert len(sizes) == -(-total // 50_000) and max(sizes.values()) < 52_000 + largest_text(found)


def test_shard_of_a_very_long_text_and_many_copies(spark):
    rows = [(i, "a b\n" * 50) for i in range(300)] + [(1, "same")] * 3000 + [(2000, "x" * 2_000_000)]
    found = sharding.shard(table(spark, rows), 6).collect()
    assert len(found) == len(rows)
    for k in range(6):
        slots = sorted(r["slot"] for r in found if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_shard_edges(spark):
    assert sharding.shard(table(spark, []), 24).count() == 0
    assert len(sharding.shard(table(spark, [(1, "a"), (1, "a"), (None, None)]), 24).collect()) == 3


def test_shared_dir_is_the_session_s(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language id", "n-gram jaccard join", "source mixing", "bpe round trip"]
    docs = common.table(spark, DIR, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels = common.table(spark, DIR, "labels")
    kept = stages.quality(spark, docs, DIR)
    assert kept.columns == docs.columns
    scores = {r["doc_id"]: r["score"] for r in gam.score(docs, gam.learn(docs, labels)).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.5}
    known = stages.language(spark, docs, DIR)
    found = {r["doc_id"]: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert known.columns == docs.columns and {r["doc_id"] for r in known.collect()} == {i for i, r in found.items() if r["lang_pred"] != "und" and r["score"] > 0}
    single = stages.near_duplicates(spark, docs, DIR)
    groups = brute_components([(i, word_set(r["text"])) for i, r in rows.items()])
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == {i for i, g in groups.items() if i == g}
    mixed = stages.mix(spark, docs, DIR)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in mixing.mix(docs).where("kept").collect()}


def test_stages_with_odd_rows_and_clashing_columns(spark):
    docs = common.table(spark, DIR, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    long = "the house by the river was old and the people who lived there liked to walk along it each day " * 3000
    odd = [(None, None, None, None, None), (10**9, None, None, None, 0), (10**9 + 1, "", None, "s", 0), (10**9 + 2, " \n\t", "en", None, 3), (10**9 + 3, long, None, "s", len(long)), (10**9 + 4, "tie tie", "en", "s", 7), (10**9 + 4, "tie tie", "en", "s", 7)]
    clash = ("score", "lang_pred", "margin", "topic", "tokens", "rate", "copies", "kept", "m_source", "component_id", "n", "c")
    both = docs.unionByName(spark.createDataFrame(odd, kinds)).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in clash})
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, both, DIR), "odd-rows")
        if name == "bpe round trip":
            assert out.count() == docs.count() + len(odd)
            continue
        assert out.columns == both.columns
        rows = out.collect()
        assert rows and all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in rows for c in clash), name
        if name == "language id":
            assert all(r["lang"] is not None for r in rows) and not {10**9, 10**9 + 1, 10**9 + 2} & {r["doc_id"] for r in rows}
            assert {r["lang"] for r in rows if r["doc_id"] == 10**9 + 3} == {"en"}


def test_repeated_keys_do_not_grow_the_training_table(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"word {k} of many " * (k % 40)) for k in range(3000)] + [(2, "the same text")] * 2000, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    fit = gam.fit
    monkeypatch.setattr(gam, "fit", lambda x, y: seen.append(len(y)) or fit(x, y))
    model = gam.learn(docs, labels, most_rows=20)
    assert seen[0] <= 60
    assert gam.score(docs, model).count() == 5000


def test_language_stage_rejects_what_is_in_no_learned_language(spark):
    rng = random.Random(1)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    junk = [letters(rng.randint(200, 3000)) for _ in range(60)]
    junk += [" ".join(letters(rng.randint(2, 9)) for _ in range(rng.randint(40, 300))) for _ in range(60)]
    junk += [base64.b64encode(rng.randbytes(rng.randint(200, 2000))).decode() for _ in range(60)]
    junk += ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(rng.randint(100, 1000))) for _ in range(60)]
    junk += ["Это обычное предложение на русском языке, которого модель никогда не видела и не должна узнавать."]
    junk += ["Tämä on tavallinen suomenkielinen lause, jota malli ei ole koskaan nähnyt eikä sen pitäisi tunnistaa sitä."]
    junk += ["Zażółć gęślą jaźń, to jest zwykłe zdanie w języku polskim, którego model nigdy nie widział ani nie zna."]
    docs = common.table(spark, DIR, "documents")
    planted = spark.createDataFrame([(10**9 + i, t, None, "planted", len(t)) for i, t in enumerate(junk)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in stages.language(spark, docs.unionByName(planted.select([F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])), DIR).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}


def test_copies_that_mixing_makes_are_encoded_once(spark, monkeypatch):
    encoder = bpe.load(bpe.default_path())
    texts = ["some words", None, "some words", "", "others", None, "some words"]
    want = [*bpe.digests(encoder, ["some words"]), *bpe.digests(encoder, [""]), *bpe.digests(encoder, ["others"])]
    seen, encode = [], encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda t: seen.append(t) or encode(t))
    assert list(bpe.digests(encoder, texts)) == [want[k] for k in (0, 1, 0, 1, 2, 1, 0)]
    assert seen == ["some words", None, "", "others"]
    got = bpe.round_trip(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == [want[k] for k in (0, 1, 0, 1, 2, 1, 0)]


def test_language_stage_identifies_each_text_once(spark, monkeypatch):
    """Floors come from what the stage keeps anyway; they are those of the labelled texts that got their own language."""
    docs = common.table(spark, DIR, "documents")
    seen, identify, floors, least = [], langid.identify, langid.floors, []
    monkeypatch.setattr(langid, "identify", lambda *a, **b: seen.append(1) or identify(*a, **b))
    monkeypatch.setattr(langid, "floors", lambda *a: least.append(floors(*a)) or least[-1])
    assert stages.language(spark, docs, DIR).count() and len(seen) == 1
    rows = [r for r in identify(docs, langid.learn(docs), keep=True).collect() if r["text"] is not None and r["lang"] == r["lang_pred"]]
    for measure in ("score", "margin"):
        for k, low in enumerate(least[0][measure]):
            steps = sorted(math.floor(r[measure] * langid.STEPS) for r in rows if sum(len(r["text"]) >= n for n in langid.LENGTHS) == k)
            assert not steps or low == steps[int(langid.FLOOR_SHARE * len(steps))]


def test_pipeline_runs(spark):
    docs = common.table(spark, DIR, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, DIR), "test-stage")
    ids = {r["doc_id"] for r in docs.collect()}
    out = entry.queries()["pipeline"](spark, DIR).collect()
    assert {r["doc_id"] for r in out} == ids and 0 < len(ids) < 200
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    from tokenizers import Tokenizer

    from clipwave.llm import bpe

    library = Tokenizer.from_file(bpe.default_path())
    for r in out:
        got = library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, got)).encode()).hexdigest()


def test_stages_on_empty_tables(spark):
    docs = common.table(spark, DIR, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, DIR), "empty-stage")
        assert out.count() == 0, name
