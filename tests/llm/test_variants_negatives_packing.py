"""Spelling variants, hard negatives and packing against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from clipwave.llm import bpe, negatives, packing, queries, variants
from pyspark.sql import functions as F

from ..conftest import DATA

SMALL = f"{DATA}/sf0.001"


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# Spelling variants


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def grouped(rows):
    """The rows of the operator: pairs by their deletion neighbourhoods (a replaced code point leaves a common one)."""
    n = counted(rows)
    holes, links = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].add(w)
            if (cut := w[:i] + w[i + 1 :]) in n:
                links[w].add(cut)
                links[cut].add(w)
    for group in holes.values():
        for a in group:
            links[a] |= group - {a}
    form = {}
    for w, others in links.items():
        if not others:
            continue
        best = min(others, key=lambda o: (-n[o], o))
        if n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), k, len(links[w]) if w in links else 0, n[form[w]] if w in form else None) for w, k in n.items()}


def test_brute_force_neighbourhoods_are_right():
    random.seed(5)
    rows = [(i, " ".join("".join(random.choices("ab", k=random.randint(6, 9))) for _ in range(30))) for i in range(20)]
    n = counted(rows)
    assert {r[0]: r[4] for r in grouped(rows)} == {w: sum(near(w, o) for o in n) for w in n}


@pytest.mark.parametrize("block", [2, 5, 128])
def test_variants_equal_brute_force_with_small_blocks(spark, monkeypatch, block):
    """Few letters, so blocks are full and are subdivided down to the last place."""
    random.seed(block)
    common = ["".join(random.choices("abé", k=7)) for _ in range(4)]
    words = ["".join(random.choices("abé", k=random.randint(7, 9))) for _ in range(500)]
    rows = [(i, " ".join(random.choices(words, k=100) + random.choices(common, k=60))) for i in range(40)]
    monkeypatch.setattr(variants, "BLOCK_ROWS", block)
    monkeypatch.setattr(variants, "SCAN_ROWS", 50)
    found = [tuple(r) for r in variants.group(texts(spark, rows)).collect()]
    assert len(found) == len(set(found))
    assert set(found) == grouped(rows)


def test_variants_of_a_chain_and_odd_rows(spark):
    rows = [(1, "tremendous " * 2000), (2, "tremendos " * 150), (3, "Tremendus " * 14), (4, None), (5, ""), (None, "tremendus-tremendos " * 2), (6, "x" * 3000 + " " + "x" * 3000), (6, "x" * 3001 + " " + "x" * 3001), (7, "ÀÉ×àéîõü aàéîõü ÀÉ×àéîõü")]
    df = texts(spark, rows).selectExpr("doc_id", "text", "'q' as word", "1 as n", "2 as short")
    found = {tuple(r) for r in variants.group(df).collect()}
    assert found == grouped(rows)
    by_word = {r[0]: r for r in found}
    assert by_word["tremendus"][2] == "tremendous" and by_word["x" * 3000][4] == 1


def test_variants_of_nothing(spark):
    assert variants.group(texts(spark, [])).count() == 0
    assert variants.group(texts(spark, [(1, "no such long word")])).count() == 0


def test_variants_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = [tuple(r) for r in queries.op11_spelling_variants(spark, SMALL).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(found) == len(set(found)) and set(found) == grouped(rows)
    assert any(r[1] for r in found)


# Hard negatives


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def mined(rows, every=5, positives=5, most=3):
    """All scores of all pairs."""
    part = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], {}
    for i, v, g in sorted(part, key=lambda r: (r[1], r[2])):
        if i % every == 0:
            asked.setdefault(i, (v, g))
    for a, (v, g) in asked.items():
        others = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, h) for j, w, h in part if j != a and len(w) == len(v))
        for s, j, _ in [o for o in others if o[2] == g][:positives]:
            fit = [o for o in others if o[2] != g and 50 * -s <= 100 * -o[0] <= 95 * -s][:most]
            out += [(a, j, k, o[1], -s, -o[0]) for k, o in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows):
    return sorted(tuple(r) for r in negatives.mine(vectors(spark, rows), F.col("vec_id") % 5 == 0).collect())


@pytest.mark.parametrize("shard", [16, 8192])
def test_negatives_equal_brute_force(spark, monkeypatch, shard):
    random.seed(shard)
    centres = [[random.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + random.gauss(0, 0.4) for c in random.choice(centres)], random.randrange(3)) for i in range(150)]
    rows += [(200 + i, [0.5] * 6, i % 2) for i in range(60)]  # one very common vector
    rows += [(300 + i, [0.25 * (i % 3), -1.0, 0.0], i % 2) for i in range(20)]  # another length
    monkeypatch.setattr(negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(negatives, "QUERY_ROWS", 4)
    monkeypatch.setattr(negatives, "BATCH_BLOCKS", 3)
    monkeypatch.setattr(negatives, "STEP", 2)
    assert run(spark, rows) == mined(rows)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (5, [2.0, 1.0], 1), (5, [2.0, 1.0], 2), (6, [1.5, 1.0], 1), (7, [1.0, 1.0], 2), (7, [1.0, 1.0], 2), (8, None, 1), (9, [1.0, None], 1), (10, [nan, 1.0], 1), (15, [inf, 1.0], 2), (None, [1.0, 1.0], 2), (20, [1.0, 1.0], None)]
    rows += [(25, [], 1), (26, [], 1), (27, [], 2), (30, [0.0, 0.0], 1), (35, [-1.0, -0.5], 2), (36, [1.0, 0.7], 1)]
    assert run(spark, rows) == mined(rows)
    assert run(spark, []) == []
    df = vectors(spark, rows).selectExpr("*", "7 as id", "true as wide", "'x' as v", "1 as n", "2 as shard", "3 as own_")
    assert sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 5 == 0).collect()) == mined(rows)


def test_negatives_with_large_components(spark):
    random.seed(3)
    rows = [(i, [random.gauss(0, 1) * 10 ** random.choice([0, 5, 9, 12]) for _ in range(3)], i % 2) for i in range(60)]
    long = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    assert run(spark, rows) == sorted((*r[:4], long(r[4]), long(r[5])) for r in mined(rows))
    huge = [(i, [random.gauss(0, 1) * 1e200, 1.0], i % 2) for i in range(30)]
    assert [r[:4] for r in run(spark, huge)] == [r[:4] for r in mined(huge)]


def test_a_scan_ends_early(spark):
    """Rows far by key are not compared."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (2000, 4)) + c for c in ([40, 0, 0, 0], [-40, 0, 0, 0], [0, 40, 0, 0], [0, -40, 0, 0])])
    whole = np.floor(x * 256)
    space = negatives.Space(negatives.pivot_rows((whole / 256)[::40].tolist(), 256), float(np.linalg.norm(whole, axis=1).max()) * (1 + 1e-12))
    d = space.distances(whole, False)
    shard = negatives.Shard(np.arange(len(x)), np.zeros(len(x), int), whole.astype(np.int64), d.argmin(axis=1), d.min(axis=1))
    seen = []
    outwards = shard.outwards
    shard.outwards = lambda *a: (seen.append(s.stop - s.start) or s for s in outwards(*a))
    q = whole[7]
    best = shard.search(space, 7, 0, q.astype(np.int64), space.distances(q[None, :], True)[0], True, [(None, None)], 5)[0]
    scores = (whole @ q).astype(int)
    want = sorted(((-int(s), i) for i, s in enumerate(scores) if i != 7))[:5]
    assert best == [(-s, i) for s, i in want]
    assert sum(seen) < len(x) / 2


# Packing


def check_pieces(pieces, tokens, window=4096):
    """Each id lies in one piece, sequences have no gaps and need no padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        assert p["length"] > 0
    assert set(by_doc) == set(tokens)
    for doc, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            ids = tokens[doc][at : at + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(tokens[doc]) and len(ids) == p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += p["length"]
        assert at == len(tokens[doc])
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window and (at == window or at & (at - 1) == 0)
    return by_sequence


def test_packing_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    tokens = {d: [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    found = queries.op13_sum_of_squares_packing(spark, SMALL).collect()
    sequences = check_pieces(found, tokens)
    assert len(sequences) <= sum(map(len, tokens.values())) / 4096 + 14
    assert len(found) < 1.5 * len(rows) + sum(len(t) // 4096 for t in tokens.values())


def test_packing_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b " * 6000), (4, "word"), (5, "<|endoftext|> x"), (6, "é" * 40)]
    df = texts(spark, rows).selectExpr("*", "1 as start", "'x' as ids", "2 as length", "3 as sequence_id").repartition(3)
    pieces = packing.pack(df).collect()
    model = bpe.load(bpe.default_path())
    check_pieces(pieces, {d: [*model.encode(t).tolist(), 2] for d, t in rows})
    assert all(zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] for p in pieces)
    assert packing.pack(texts(spark, [])).count() == 0
    again = packing.pack(texts(spark, [(1, "same text")] * 50), with_ids=False).collect()
    assert len({(p["sequence_id"], p["offset"]) for p in again}) == len(again) >= 50
    assert sum(p["length"] for p in again) == 50 * again[0]["doc_tokens"]


def test_level_minimises_sum_of_squares():
    random.seed(2)
    packer = packing.Packer(32)
    for k in range(600):
        size = random.choice([1, 5, 7, 11, 13, 20, 31]) if k % 3 else random.randint(1, 31)
        squares = {}
        for h in [0, *(h for h in range(1, 32) if packer.levels[h] and h + size <= 32)]:
            after = packer.levels.copy()
            after[h] -= 1 if h else 0
            after[h + size] += 1 if h + size < 32 else 0
            squares[h] = int((after**2).sum())
        level = packer.level_for(size)
        assert squares[level] == min(squares.values())
        full = packer.place((k, 0, np.zeros(size, np.int32)))
        assert (full is not None) == (level + size == 32)
        assert packer.n_open == packer.levels.sum() == sum(map(len, packer.open.values()))


@pytest.mark.parametrize("most", [3, 4096])
def test_settling_keeps_every_token(monkeypatch, most):
    monkeypatch.setattr(packing, "MOST_OPEN", most)
    for seed in range(60):
        random.seed(seed)
        packer, windows, size = packing.Packer(16), [], {}
        for k in range(random.randint(0, 40)):
            size[k] = random.randint(1, 40)
            windows += packer.add(k, np.arange(size[k], dtype=np.int32))
        full = len(windows)
        windows += packer.finish()
        assert all(sum(len(p[2]) for p in w) == 16 for w in windows[:full])
        sums = [sum(len(p[2]) for p in w) for w in windows]
        assert all(n == 16 or n & (n - 1) == 0 for n in sums) and len([n for n in sums if n < 16]) <= 4
        at = defaultdict(list)
        for doc, start, ids in itertools.chain(*windows):
            assert ids.tolist() == list(range(start, start + len(ids)))
            at[doc] += ids.tolist()
        assert {d: sorted(x) for d, x in at.items()} == {d: list(range(n)) for d, n in size.items()}


def test_words_are_merged_many_at_once(monkeypatch):
    """Packing gets a slice's new words by matrices of merges, as the encoder of single words and the library give them."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from clipwave.llm import bpe
    from clipwave.llm.wordmerges import merges

    rng, path = random.Random(2), public_tokenizers.path("word_bpe_49k.json")
    letters = "abcdefghijklmnopqrstuvwxyzABCéèçàñüß0123456789!?#-_ 你好ыв😀 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 30, 400]))) for _ in range(600)]
    texts += [None, "", " ", "a" * 5000, "ab" * 24, *("a" * n for n in range(1, 60)), "say <|endoftext|> twice <|endoftext|>", "the thethe \u0378 they"]
    library, many = Tokenizer.from_file(path), merges(path)
    library.no_truncation()
    library.no_padding()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    many.bpe.words.forget()
    monkeypatch.setattr("clipwave.llm.wordmerges.REMEMBERED", 300)
    assert [x.tolist() for k in range(0, len(texts), 50) for x in many.encode_texts(texts[k : k + 50])] == want
    words = sorted({w for t in texts if t for w in many.bpe.split(t) if len(w.encode()) <= 48})
    assert len(words) > 1000 and many.encode(words) == [bpe.load(path).encode_word(w) for w in words]
    many.bpe.words.forget()
    monkeypatch.setattr(bpe.Bpe, "encode_word", None)  # not a word goes through the encoder of single words
    assert [x.tolist() for x in many.encode_texts(["some wholly ordinary wordings"])] == [library.encode("some wholly ordinary wordings", add_special_tokens=False).ids]
