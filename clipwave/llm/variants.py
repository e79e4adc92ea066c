"""Spelling variants: words one edit apart, from forward and reversed sorted dictionaries.

If one code point is inserted, deleted or replaced, either the first or the second half of
the word is intact. So all words are entered in two dictionaries, a forward one by their
first half and a reversed one by their second half; each is range-partitioned and sorted, and
near words stand in one *block* of it: a run of equal keys. A word of length L is entered for
two lengths of the shorter word of a pair, L and L - 1.

A block with more than ``BLOCK_ROWS`` words is subdivided before it is scanned: of the part
of the word that may hold the edit, again one half is intact, so its words are entered once
more by that half too. Where a single place is left, a block can't hold more words than the
alphabet lets it (90 letters), whatever the dictionary holds. So no block grows with the
data, and none is cut short.

A block is scanned by comparing each entry with those behind it, all entries of a batch at a
time; a pair is near if common beginning and common end leave one code point of the longer
word. It counts where the end of the common beginning lies in the half that the block stands
for, so it counts once. Pairs are summed in the task: what leaves it is one row for each word
and batch, with the number of near words and the best of them.

Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, A to Z lower-cased; of every 31st (document,
run) by checksum one code point is dropped, so variants with known origin exist.

Edge cases: null and empty texts have no words; a null id counts as the empty string in the
checksum; runs of any length count (a block holds at most BLOCK_ROWS of them at once); rows
that repeat count each; ties between forms go to the smaller word in code-point order; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import begin, give_back, materialize

#: Words of a block that are compared directly.
BLOCK_ROWS = 128
#: Entries, and bytes of words, that a task compares at once.
SCAN_ROWS, SCAN_BYTES = 20_000, 4 << 20


def without_at(word: Column, place: Column) -> Column:
    """``word`` without its code point at ``place`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def words(docs: DataFrame, least: int = 7, often: int = 2, every: int = 31, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n``, its occurrences: words of at least ``least`` code points that occur ``often`` times."""
    run = F.explode(F.regexp_extract_all(text, F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), 0))
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hashed = runs.select("id", lower.alias("run")).withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    dropped = F.when(F.col("h") % every == 0, without_at(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    return hashed.select(dropped.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def keyed(entries: DataFrame) -> DataFrame:
    """``head`` and ``tail``: what the words of a block share."""
    length = F.length("word")
    return entries.withColumn("head", F.substring("word", F.lit(1), F.col("head_size"))).withColumn("tail", F.reverse(F.substring("word", length - F.col("tail_size") + 1, F.col("tail_size"))))


KEY = ("short", "head_size", "tail_size", "head", "tail")
ENTRY = ("word", "n", "short", "head_size", "tail_size", "upto")


def part(head: Column, tail: Column, upto: Column) -> Column:
    return F.struct(head.alias("head_size"), tail.alias("tail_size"), upto.alias("upto"))


def dictionaries(found: DataFrame, least: int = 7) -> DataFrame:
    """Both dictionaries: each word by its first and by its second half, for both lengths of the shorter word.

    ``upto``: a pair counts if its common beginning is shorter than that (it is ``head_size`` at least)."""
    length = F.length("word")
    e = found.select("word", "n", F.explode(F.array(length, length - 1)).alias("short")).where(F.col("short") >= least)
    half = F.floor(F.col("short") / 2).cast("int")
    sides = F.array(part(half, F.lit(0), F.col("short") + 1), part(F.lit(0), F.col("short") - half, half))
    return keyed(e.withColumn("side", F.explode(sides)).select("word", "n", "short", "side.*"))


def subdivided(entries: DataFrame) -> DataFrame:
    """The entries of too large blocks by half of the part that may differ."""
    free = F.col("short") - F.col("head_size") - F.col("tail_size")
    half = F.floor(free / 2).cast("int")
    at = F.col("head_size") + half
    halves = F.array(part(at, F.col("tail_size"), F.col("upto")), part(F.col("head_size"), F.col("short") - at, at))
    # One place left. Replaced: words of the same length alone. Inserted before it, or (at the word's end) behind it: the shorter word's code point is shared.
    h, t = F.col("head_size"), F.col("tail_size")
    replaced = F.when(F.length("word") == F.col("short"), part(h, t, F.lit(-1)))
    last = F.array(replaced, part(h, t + 1, h + 1), F.when(t == 0, part(h + 1, t, F.col("upto"))))
    parts = F.explode(F.filter(F.when(free > 1, halves).otherwise(last), lambda x: x.isNotNull()))
    return keyed(entries.withColumn("part", parts).select("word", "n", "short", "part.*"))


def aligned(block: list[bytes], width: int, right: bool) -> np.ndarray:
    """Words as rows of a matrix, from their beginnings or (backwards) from their ends."""
    padded = [w.rjust(width, b"\0")[::-1] if right else w.ljust(width, b"\0") for w in block]
    return np.frombuffer(b"".join(padded), dtype=np.uint8).reshape(len(block), width)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many code points of each two rows agree from the left."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def pairs_of(found: list[bytes], short: int, head: np.ndarray, tail: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the near pairs among sorted entries for one length of the shorter word."""
    size = np.array([len(w) for w in found])
    left, right = aligned(found, short + 1, False), aligned(found, short + 1, True)
    same = (head[1:] == head[:-1]) & (tail[1:] == tail[:-1]) & (common(left[1:], left[:-1]) >= head[1:]) & (common(right[1:], right[:-1]) >= tail[1:])
    block = np.concatenate([[0], np.cumsum(~same)])
    first, second = [np.empty(0, int)], [np.empty(0, int)]
    at = np.arange(len(found))
    for d in range(1, len(found)):
        at = at[at + d < len(found)]
        at = at[block[at] == block[at + d]]
        if not len(at):
            break
        a = at[(size[at] == short) | (size[at + d] == short)]
        begin_, end_ = common(left[a], left[a + d]), common(right[a], right[a + d])
        longer = np.maximum(size[a], size[a + d])
        # upto -1: only replaced code points count here, wherever they are.
        near = (np.minimum(begin_, longer) + np.minimum(end_, longer) >= longer - 1) & ((begin_ < upto[a]) | (upto[a] < 0))
        first.append(a[near])
        second.append(a[near] + d)
    return np.concatenate(first), np.concatenate(second)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each word, as far as the batch shows them: how many, and the best."""
    begin("variants")

    def compared(t: pa.Table) -> pa.RecordBatch:
        names, n, short = t.column("word").to_pylist(), t.column("n").to_numpy(), t.column("short").to_numpy()
        found = [w.encode("latin-1") for w in names]
        columns = [t.column(c).to_numpy() for c in ("head_size", "tail_size", "upto")]
        first, second = [], []
        edges = [0, *(np.flatnonzero(np.diff(short)) + 1), len(found)]
        for a, b in zip(edges, edges[1:], strict=False):
            i, j = pairs_of(found[a:b], int(short[a]), *(c[a:b] for c in columns))
            first += [i + a, j + a]
            second += [j + a, i + a]
        i, j = np.concatenate(first), np.concatenate(second)
        # Words in code-point order: Latin-1 bytes are code points.
        place = np.empty(len(found), dtype=int)
        place[sorted(range(len(found)), key=found.__getitem__)] = np.arange(len(found))
        order = np.lexsort((place[j], -n[j], i))
        i, j = i[order], j[order]
        row, start, count = np.unique(i, return_index=True, return_counts=True)
        best = j[start]
        return pa.RecordBatch.from_pydict({"word": pa.array([names[r] for r in row], pa.string()), "n_near": pa.array(count, pa.int64()), "best_n": pa.array(n[best], pa.int64()), "best": pa.array([names[r] for r in best], pa.string())})

    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < SCAN_ROWS and size < SCAN_BYTES:
            continue
        t = pa.Table.from_batches(held)
        keys = t.select(list(KEY))
        stop = rows - 1  # the last block may go on in the next batch
        last = keys.slice(stop, 1).to_pylist()
        while stop > 0 and keys.slice(stop - 1, 1).to_pylist() == last:
            stop -= 1
        if stop:
            yield compared(t.slice(0, stop))
            held = t.slice(stop).to_batches()
            rows, size = rows - stop, sum(b.nbytes for b in held)
    if rows:
        yield compared(pa.Table.from_batches(held))
    give_back()


def near_words(found: DataFrame, least: int = 7) -> DataFrame:
    """``word``, ``n_near``, ``best`` (the near word of largest n) and ``best_n`` of the words that have near ones. ``found``: word, n."""
    entries, parts = dictionaries(found, least), []
    while True:
        entries = materialize(entries, "variants-entries")
        some = F.min(F.length("word")) == F.col("short")
        sizes = entries.groupBy(*KEY).agg(F.count("*").alias("block_rows"), some.alias("some")).where("block_rows > 1 and some").drop("some")
        held = materialize(entries.join(sizes, list(KEY)), "variants-blocks")
        free = F.col("short") - F.col("head_size") - F.col("tail_size")
        large = (F.col("block_rows") > BLOCK_ROWS) & (free > 0) & (F.col("upto") >= 0)
        parts.append(held.where(~large).select(*ENTRY, "head", "tail"))
        if held.where(large).isEmpty():
            break
        entries = subdivided(held.where(large).select(*ENTRY))
    blocks = parts[0]
    for p in parts[1:]:
        blocks = blocks.unionByName(p)
    blocks = blocks.repartitionByRange(*KEY).sortWithinPartitions(*KEY, "word")
    partial = blocks.mapInArrow(scan, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: follow ``form`` to the last, by pointer doubling. A form is more frequent than its word by a factor, so chains are short and have no cycle."""
    reached = materialize(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(reached.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def group(docs: DataFrame, factor: int = 10, least: int = 7, often: int = 2, every: int = 31, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every word with its ``form`` (the near word of largest n, if that is ``factor`` times its own n) and ``root``."""
    found = materialize(words(docs, least, often, every, key, text), "variants-words")
    near = near_words(found, least)
    named = F.col("best_n") >= factor * F.col("n")
    formed = materialize(found.join(near, "word", "left").select("word", F.when(named, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(named, F.col("best_n")).alias("form_n")), "variants-forms")
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
