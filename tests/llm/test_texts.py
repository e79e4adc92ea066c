"""Operators on single texts: against brute force, other libraries, or held-out accuracy."""

import gc
import hashlib
import os
import random
import weakref
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clipwave.llm import bpe, chat, gam, langid, queries, rules, textstats, tokencounts

from ..conftest import DATA

DIR = f"{DATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, n_words string, size string"
ODD = [None, "", " \t\n", "word", "<|endoftext|>x <|startoftext|>", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ ﬁ", "x\n" * 5000, "a b c " * 60_000, "😀👍🏽", "1\x1c2\x853\xa04", "don'T we'LL 'S", "café"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0, 1.0, "x", "y", "z") for i, t in enumerate(ODD)] + [(1, "", None, None, None, None, None, None, None), (3, "word", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def test_bpe_like_the_library(library):
    rng = random.Random(5)
    letters = "abcdefghij'!#$%&*éüßñ 1234567890\n\t<|>Σσ"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    encoder = bpe.load(bpe.default_path())
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = encoder.encode(t)
        assert got.tolist() == want, t[:80]
        assert encoder.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_bpe_of_every_code_point(library):
    encoder = bpe.load(bpe.default_path())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for k in range(0, len(every), 50_000):
        texts = [f"a{c}1" for c in every[k : k + 50_000]]
        for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert encoder.encode(t).tolist() == want.ids, ascii(t)
    encoder.words.forget()


def test_bpe_of_random_code_points(library):
    rng = random.Random(11)
    points = [c for c in range(0x20, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    encoder = bpe.load(bpe.default_path())
    for _ in range(1500):
        t = "".join(chr(rng.choice(points)) if rng.random() < 0.7 else rng.choice("ab 1'\n<|") for _ in range(rng.randint(1, 40)))
        want = library.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t).tolist() == want, ascii(t)
        assert encoder.decode(encoder.encode(t)).decode() == library.decode(want, skip_special_tokens=False)


def test_cleared_tables_are_freed():
    b = bpe.load(bpe.default_path())
    b.encode("some words, to fill the tables of pairs")
    gone = weakref.ref(b)
    del b
    bpe._clear_all()
    gc.collect()
    assert gone() is None


def test_round_trip_query(spark, library):
    out = {r["doc_id"]: r for r in queries.op6_bpe_round_trip(spark, DIR).collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = out[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_and_decode_tables(odd, empty, library):
    out = bpe.decode_documents(bpe.encode_documents(odd)).collect()
    assert len(out) == len(ODD) + 2
    for r in out:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want) and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(empty).count() == 0 and bpe.round_trip(empty).count() == 0


def test_token_histogram(spark, odd, empty, library):
    counted = tokencounts.lengths(odd)
    sizes = [len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect()]
    bars = tokencounts.histogram(counted)
    assert sorted(map(tuple, bars.collect())) == tokencounts.brute_force(sizes)
    for r in tokencounts.for_limits(bars, [0, 3, 1000, 10**9]).collect():
        assert (r["n_docs"], r["total_tokens"], r["docs_over"], r["tokens_cut"]) == (len(sizes), sum(sizes), sum(s > r["limit"] for s in sizes), sum(min(s, r["limit"]) for s in sizes))
    got = {r["q"]: r["n_tokens"] for r in tokencounts.quantiles(bars, [0.0, 0.5, 1.0]).collect()}
    assert got == {q: np.quantile(sizes, q, method="inverted_cdf") for q in got}
    none = tokencounts.histogram(tokencounts.lengths(empty))
    assert none.count() == 0 and tokencounts.quantiles(none, [0.5]).first()["n_tokens"] is None
    assert tokencounts.for_limits(none, [5]).first()["total_tokens"] == 0


def test_languages_held_out(spark):
    out = queries.op1_language_id(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_edges(spark, odd, empty):
    profiles = langid.learn(odd)
    got = {r["doc_id"]: r for r in langid.identify(odd, profiles).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[0]["score"] == 0
    assert got[8]["lang_pred"] == "en" and got[9]["lang_pred"] == "und"
    assert langid.learn(empty).languages == [] and {r["lang_pred"] for r in langid.identify(odd, langid.learn(empty)).collect()} == {"und"}
    kept = langid.identify(odd, profiles, keep=True)
    assert set(odd.columns) | {"lang_pred", "margin"} == set(kept.columns) and kept.count() == len(ODD) + 2


def test_bundles_are_sums_of_bound_vectors():
    text = "abz é 12 ab"
    codes = np.concatenate(list(langid.trigrams(text)))
    two, one, none = langid.letter_vectors(64)
    want = sum(two[c // langid.PLACES**2] * one[c // langid.PLACES % langid.PLACES] * none[c % langid.PLACES] for c in codes)
    assert np.array_equal(langid.bundles([list(langid.trigrams(text))], 64)[0], want)


def test_trigrams_of_blocks(monkeypatch):
    text = "some words, and  more -- words " * 50
    whole = np.concatenate(list(langid.trigrams(text)))
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert np.array_equal(np.sort(whole), np.sort(np.concatenate(list(langid.trigrams(text)))))


def brute_stats(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[ \t\n\x0b\x0c\r]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)} if len(words) < 3000 else None
    lines, again = text.split("\n"), 0
    for i, line in enumerate(lines):
        again += bool(line.strip(" \t\x0b\x0c\r")) and line in lines[:i] if len(lines) < 3000 else 0
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again if len(lines) < 3000 else None, None if inside is None else len(inside)


def test_counts():
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["aa", "b", "#", "é", " ", "  ", "\n", "\r\n", "\x0b", " x y z "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    for t in texts:
        for got, want in zip(textstats.measure(t), brute_stats(t), strict=False):
            assert want is None or got == want, t


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    out = queries.op5_quality_gam(spark, f"{DATA}/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.95 * len(out)


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (3, 0), (3, 1), (8, 0), (11, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = gam.learn(odd, labels)
    out = gam.score(odd, model).collect()
    assert len(out) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in out)
    assert gam.score(empty, model).count() == 0
    nothing = gam.learn(empty, labels)
    assert {r["score"] for r in gam.score(odd, nothing).collect()} == {0.5}
    assert set(gam.score(odd, model, keep=True).columns) == set(odd.columns)


def test_gam_finds_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(4000, len(gam.NAMES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    m = gam.fit(x, y)
    assert (0, 3) in m.pairs and ((m.score(x) >= 0.5) == y).mean() > 0.9


def test_rules(spark, odd, empty):
    rng = np.random.default_rng(6)
    x = {n: rng.integers(0, 1000, 2000) for n in rules.SHARES}
    bad = (x["symbols"] > 700) | ((x["upper"] > 600) & (x["digits"] <= 300))
    found = rules.fit(x, bad, rng.random(2000) < 0.66)
    hit = np.zeros(2000, dtype=bool)
    for r in found.rules:
        hit |= rules.covers(r, x, 2000)
    assert (hit == bad).mean() > 0.97 and str(found).endswith("else keep")
    out = {r["doc_id"]: r for r in rules.apply(odd, rules.DecisionList()).collect()}
    assert out[0]["n_words"] == 0 and out[0]["base_failed"] and not out[0]["kept"] and out[8]["base_failed"]
    assert rules.apply(empty, rules.DecisionList()).count() == 0
    assert rules.learn(empty, spark.createDataFrame([], "doc_id long, quality int")).rules == []


def test_rules_query(spark):
    d = f"{DATA}/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    right = seen = 0
    for r in queries.op9_quality_rules(spark, d).collect():
        n, chars, symbols, dup, repeat = brute_stats(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (n, chars, symbols)
        assert dup is None or r["n_dup_lines"] == dup
        assert repeat is None or (r["n_repeat_words"] == repeat and r["base_failed"] == (n < 50 or 100 * repeat > 50 * n))
        assert not (r["base_failed"] and r["kept"])
        if not r["base_failed"] and r["doc_id"] in labels:
            seen, right = seen + 1, right + (r["kept"] == (labels[r["doc_id"]] == 1))
    assert right >= 0.95 * seen


CHAT = "conv_id long, turn long, role string, text string, window string"


def test_chat_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 0, "system", "sys <|", "w"), (1, 1, "user", None, "w"), (1, 2, "assistant", "<\\|im_end|> \\ < | <\\\\|x\n\n", "w"), (1, 2, "assistant", "tie", None),
        (2, None, None, said, "w"), (2, 5, "us%er\nx%0A", "<", "w"), (None, 0, "assistant", "lost", "w"), (3, 0, "assistant", "x" * 30_000, "w"), (3, 1, "assistant", "é" * 700, "w"), (3, 2, "user", "z", "w"),
    ] + [(4, t, "user" if t % 2 == 0 else "assistant", f"say {t} " * (t % 40), "w") for t in range(200)] + [(4, 199, "assistant", "say 199 " * 39, "w")]
    got = {r["conv_id"]: r for r in chat.digests(chat.windows(spark.createDataFrame(rows, CHAT))).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        learned = "".join(x for *_, r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), digest)
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_windows_keep_the_budget(spark):
    rows = [(4, t, "system" if t == 0 else "user" if t % 2 else "assistant", f"say {t} " * (t % 60), "w") for t in range(300)]
    out = chat.windows(spark.createDataFrame(rows, CHAT), stride=256, history=128).collect()
    tokens = lambda t: -(-len((chat.START + t[2] + "\n" + t[3] + chat.END + "\n").encode()) // 4)
    longest = max(map(tokens, rows))
    assert len(out) > 10 and sum(r["n_turns"] for r in out) == 300
    for r in out:
        assert r["tokens"] <= tokens(rows[0]) + 128 + max(256, longest)
        assert r["formatted"].startswith("<|im_start|>system\n")
        for s in r["loss"]:
            assert r["formatted"][: s["start"]].endswith("<|im_start|>assistant\n") and r["formatted"][s["start"] + s["length"] :].startswith(chat.END)


def test_chat_empty(spark):
    assert chat.digests(chat.windows(spark.createDataFrame([], CHAT))).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_native_plans(spark):
    for name in ("op4_chat_windows", "op8_source_mixing"):
        plan = queries.queries()[name](spark, DIR)._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow")), name
    assert F is not None
