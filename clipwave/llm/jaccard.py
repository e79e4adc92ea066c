"""Exact n-gram Jaccard join by T-occurrence search.

Two documents link when 100 * |A n B| >= 80 * |A u B| for their sets of five-word shingles.
A partner of a document with n shingles shares at least T = ceil(0.8 n) of them, so it
occurs in at least T of the n inverted lists of its shingles: the T-occurrence problem.

Spark deals the work so that nothing but possible partners ever meets:

1.  Documents with equal sets are one class; only one of each class goes on.
2.  Peeling. A shingle that only one class has helps none of its T occurrences, so a class
    with more than n - T of them has no partner at all. First this is shown for most
    classes with a fixed part of the hash range (shingles whose hash is low, the same ones
    for every document), then for the rest, round after round, with all their shingles.
    That is the case of DivideSkip in which the short lists have one entry.
3.  The survivors' short lists: of each class the n - T + 1 rarest shingles. Partners share
    at least one. Classes joined by such lists form groups.
4.  In a group, DivideSkip: a query's lists are divided by length; the short ones are merged
    by one sort, candidates that occur in enough of them are looked up in the long ones by
    binary search, if they can still reach T. Queries start with the smallest
    component and end when all that is left lies in one, as only components are asked for.
    A group that is too large for a task is dealt into blocks, whose trees are joined by
    representatives; only what then isn't in the group's largest component meets all blocks.
5.  The trees that links make (never all pairs) give the connected components.

Every step is exact: bounds only rule out what can't link, hashes of 64 bits stand for
shingles, and of 64 bits and the size for sets.

Words are maximal runs of anything but space and characters 9 to 13, after A-Z were
lower-cased. Edge cases: a text of fewer than five words has one shingle, all its words;
one without words, or null, has none and links with nothing. Rows that repeat a key are
one document with several texts: a link of any of them counts, each row is returned. Rows
without a key get component null. Very long texts are shingled whole. An empty table gives
an empty result. Only the named columns of the input are read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, begin, give_back, map_slices, materialize, slices
from .components import components

WORDS = 5
#: Part of the hash range in which shingles of all documents are compared first.
PART = 0.3
#: The hash range.
EVERY = 1 << 64
#: Shingles in one bucket of that comparison, and in one block of the search; rows in one block.
BUCKET, TASK, ROWS = 400_000, 400_000, 128
#: Most times that representatives are dealt anew (any number is exact).
MOST_DEALS = 8
#: Rounds of peeling among the survivors (any number is exact); choosing short lists is one more.
PEELS = 1
#: Most keys that are broadcast; more are joined by a shuffle.
BROADCAST = 1_000_000
MANY = 0

#: What parts words, what they are lower-cased to, and the bits of a word's last bytes.
SPACE, LOWER = np.zeros(256, dtype=bool), np.arange(256, dtype=np.uint8)
SPACE[[32, *range(9, 14)]] = True
LOWER[ord("A") : ord("Z") + 1] += 32
TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes of the longest words that are hashed together, eight bytes at a time.
TOGETHER = 64


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts, and how many words each text has; null has none."""
    held = pc.fill_null(texts.cast(pa.binary()), b"")
    offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
    size = offsets[-1] - offsets[0]
    if not size:
        return np.empty(0, np.uint64), np.zeros(len(held), np.int64)
    raw = np.frombuffer(held.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    lower = np.zeros(size + 8, dtype=np.uint8)
    LOWER.take(raw, out=lower[:size])
    inside = np.zeros(size + 2, dtype=bool)
    np.logical_not(SPACE[raw], out=inside[1:-1])
    border = np.zeros(size + 1, dtype=bool)  # before and behind a text
    border[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | border[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | border[1:])) + 1
    length = ends - starts
    h = length.astype(np.uint64)
    eight = np.ndarray(size + 1, "<u8", lower, strides=(1,))
    todo = np.flatnonzero(length <= TOGETHER)
    at = starts[todo]
    while len(todo):
        left = ends[todo] - at
        x = h[todo] ^ (eight[at] & TAIL[np.minimum(left, 8)])
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        h[todo] = x ^ (x >> np.uint64(29))
        more = left > 8
        todo, at = todo[more], at[more] + 8
    for i in np.flatnonzero(length > TOGETHER).tolist():
        h[i] = xxhash.xxh3_64_intdigest(lower[starts[i] : ends[i]])
    return h, np.diff(np.searchsorted(starts, offsets))


def mixed(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` hashes in a row."""
    n = len(h) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out ^= h[k : k + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes (uint64) of each text's shingles; all texts are hashed together."""
    h, words = word_hashes(texts)
    every = mixed(h, WORDS) if len(h) >= WORDS else h[:0]  # also those that begin in one text and end in the next
    fresh = np.ones(len(every), dtype=bool)
    out, spans, at = [h[:0]] * len(texts), [], 0
    for i, n in enumerate(words.tolist()):
        if n >= WORDS:
            every[at : at + n - WORDS + 1].sort()
            spans.append((i, at, at + n - WORDS + 1))
        elif n:
            out[i] = mixed(h[at : at + n], n)
        at += n
    np.not_equal(every[1:], every[:-1], out=fresh[1:])
    for i, a, b in spans:
        fresh[a] = True
        out[i] = every[a:b][fresh[a:b]]
    return out


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()))[0]


def class_of(s: np.ndarray) -> int:
    """64 bits that stand for a set; never MANY."""
    return (xxhash.xxh3_64_intdigest(s.tobytes()) | 1) - (1 << 63) if len(s) else -1


def required(n: int, m: int, percent: int = 80) -> int:
    """Least intersection of sets of sizes n and m that link: 100 i >= p (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``n``, ``c`` (class) and ``low`` (the hashes in the low part of the hash range, packed) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    top = np.uint64(int(PART * EVERY))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column(text))
        low = [s[: s.searchsorted(top)].tobytes() for s in sets]
        return pa.RecordBatch.from_arrays([part.column(key), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), pa.array(low, pa.binary())], names=[key, "n", "c", "low"])

    return map_slices(docs.select(key, text), work, f"`{key}` {kind}, n long, c long, low binary", text, "jaccard")


def hashes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a column of packed or listed ones, and how many each row has."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64), pc.binary_length(column).to_numpy(zero_copy_only=False) // 8


def by_bucket(rows: DataFrame, column: str, buckets: int, top: int, pack: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """The hashes of ``column`` with their ``c``, dealt by ``bucket`` of the hash range up to ``top``.

    They travel as packed arrays, one row for each bucket and BUCKET hashes of a task: ``pack`` gets them in order of hash
    and gives the hashes that go on, and what goes with them."""
    step = np.uint64(min(EVERY - 1, -(-top // buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard")
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            found = pack(h[order], c[order])
            bucket = np.minimum(next(iter(found.values())) // step, np.uint64(buckets - 1)).astype(np.int64)
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            used = [b for b in range(buckets) if ends[b + 1] > ends[b]]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32())} | {k: pa.array([x[ends[b] : ends[b + 1]].tobytes() for b in used], pa.binary()) for k, x in found.items()})

        for part in slices(batches, column):
            flat, each = hashes_of(part.column(column))
            if len(flat):
                held.append((flat, np.repeat(part.column("c").to_numpy(), each)))
                size += len(flat)
            if size > BUCKET:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        give_back()

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return rows.where("n > 0").select("c", column).mapInArrow(run, schema)


def unpacked(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(column).to_pylist()])


def runs_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return first, np.concatenate([first[1:], [len(h)]]) - 1


def one_or_many(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each run of ``h``, and its class; MANY where it has several."""
    first, _ = runs_of(h)
    low, high = np.minimum.reduceat(c, first), np.maximum.reduceat(c, first)
    return first, np.where(low == high, low, MANY)


def dealt_by_class(replies: int, c: np.ndarray, **more: np.ndarray) -> pa.Table:
    """``reply`` and packed arrays: what belongs to the classes of each reply."""
    reply = c % replies
    order = np.argsort(reply, kind="stable")
    ends = np.searchsorted(reply[order], np.arange(replies + 1))
    used = [b for b in range(replies) if ends[b + 1] > ends[b]]
    arrays = {k: x[order] for k, x in ({"cs": c} | more).items()}
    return pa.table({"reply": pa.array(used, pa.int32())} | {k: pa.array([x[ends[b] : ends[b + 1]].tobytes() for b in used], pa.binary()) for k, x in arrays.items()})


def lonely(rows: DataFrame, column: str, total: int, top: int) -> DataFrame:
    """``c`` and ``u``: how many hashes of ``column``, all under ``top`` and about ``total`` of them, only this class has."""
    buckets = max(1, round(total / BUCKET))
    replies = max(1, buckets // 2)

    def pack(h: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        first, c = one_or_many(h, c)
        return {"hs": h[first], "cs": c}

    def compare(table: pa.Table) -> pa.Table:
        begin("jaccard")
        h, c = unpacked(table, "hs", np.uint64), unpacked(table, "cs", np.int64)
        order = np.argsort(h)
        _, c = one_or_many(h[order], c[order])
        return dealt_by_class(replies, c[c != MANY])

    def count(table: pa.Table) -> pa.Table:
        c, u = np.unique(unpacked(table, "cs", np.int64), return_counts=True)
        return pa.table({"c": c, "u": u.astype(np.int64)})

    packed = by_bucket(rows, column, buckets, top, pack, "bucket int, hs binary, cs binary")
    own = packed.groupBy("bucket").applyInArrow(compare, "reply int, cs binary")
    return own.groupBy("reply").applyInArrow(count, "c long, u long")


def keyed(docs: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose key is among ``keys`` (``left_anti``: isn't): by broadcast up to BROADCAST keys, else by a shuffle."""
    few = keys.limit(BROADCAST + 1).count() <= BROADCAST
    return docs.join(F.broadcast(keys) if few else keys.hint("merge"), key, how)


def survivors(docs: DataFrame, described: DataFrame, key: str, text: str) -> DataFrame:
    """``node`` (the class's smallest key), ``n`` and ``s`` (sorted hashes) of the classes that may have partners."""
    slack = F.expr("n - (4 * n + 4) div 5")
    total = described.agg(F.sum("n")).first()[0] or 0
    classes = described.where(F.col(key).isNotNull() & (F.col("n") > 0)).groupBy("c", "n").agg(F.min(key).alias("node"))
    left = classes.join(lonely(described, "low", total * PART, int(PART * EVERY)), "c", "left").where(F.coalesce("u", F.lit(0)) <= slack)
    nodes = materialize(left.select("node", "c", "n"), "nodes")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column("text"))
        return pa.RecordBatch.from_arrays([part.column("node"), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "c", "s"])

    texts = keyed(docs.select(F.col(key).alias("node"), F.col(text).alias("text")), nodes.select("node").distinct(), "node")
    sets = map_slices(texts, work, "node long, c long, s array<long>", operator="jaccard").dropDuplicates(["node", "c"])
    now = materialize(sets.join(nodes, ["node", "c"]).select("node", "c", "n", "s"), "sets")
    for _ in range(PEELS):
        alone = lonely(now, "s", now.agg(F.sum("n")).first()[0] or 0, EVERY)
        now = materialize(now.join(alone, "c", "left").where(F.coalesce("u", F.lit(0)) <= slack).select("node", "c", "n", "s"), "sets")
    return now


def short_lists(sets: DataFrame) -> DataFrame:
    """``node`` and ``h``: of each node its n - T + 1 rarest shingles, without those that no other node has.

    The latter come first in order of length and take up places, so a node with over n - T of them has no short list: it has no partner."""
    buckets = max(1, round((sets.agg(F.sum("n")).first()[0] or 0) / BUCKET))

    def compare(table: pa.Table) -> pa.Table:
        begin("jaccard")
        h, c = unpacked(table, "hs", np.uint64), unpacked(table, "cs", np.int64)
        order = np.argsort(h)
        first, last = runs_of(h[order])
        length = np.repeat(last - first + 1, last - first + 1)
        shared = order[length > 1]
        return dealt_by_class(buckets, c[shared], hs=h[shared], fs=length[length > 1])

    def choose(lists: pa.Table, nodes: pa.Table) -> pa.Table:
        begin("jaccard")
        if not (lists.num_rows and nodes.num_rows):
            return pa.table({"node": pa.array([], pa.int64()), "h": pa.array([], pa.int64())})
        c, h, f = unpacked(lists, "cs", np.int64), unpacked(lists, "hs", np.uint64), unpacked(lists, "fs", np.int64)
        order = np.lexsort((h, f, c))
        c, h = c[order], h[order]
        first, last = runs_of(c)
        own = nodes.column("c").to_numpy()
        at = np.argsort(own)
        place = at[np.searchsorted(own[at], c[first])]
        n, node = nodes.column("n").to_numpy()[place], nodes.column("node").to_numpy()[place]
        size = last - first + 1
        places = np.maximum(0, size - (4 * n + 4) // 5 + 1)
        kept = np.arange(len(c)) - np.repeat(first, size) < np.repeat(places, size)
        return pa.table({"node": np.repeat(node, size)[kept], "h": h[kept].view(np.int64)})

    packed = by_bucket(sets, "s", buckets, EVERY, lambda h, c: {"hs": h, "cs": c}, "bucket int, hs binary, cs binary")
    lists = packed.groupBy("bucket").applyInArrow(compare, "reply int, cs binary, hs binary, fs binary")
    nodes = sets.select("node", "c", "n", F.pmod("c", F.lit(buckets)).cast("int").alias("reply"))
    return lists.groupBy("reply").cogroup(nodes.groupBy("reply")).applyInArrow(choose, "node long, h long")


def groups(sets: DataFrame) -> DataFrame:
    """``node`` and ``component``: nodes joined by a short list."""
    short = materialize(short_lists(sets), "short-lists")
    edges = short.join(short.groupBy("h").agg(F.min("node").alias("m")), "h").where("node != m").select(F.col("node").alias("a"), F.col("m").alias("b")).distinct()
    return components(edges)


class Forest:
    """Union-find with sizes."""

    def __init__(self, n: int) -> None:
        self.up, self.size = list(range(n)), [1] * n

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        if self.size[x] < self.size[y]:
            x, y = y, x
        self.up[y] = x
        self.size[x] += self.size[y]
        return True


class DivideSkip:
    """T-occurrence search over the sets of one group, which are sorted by size."""

    def __init__(self, sets: list[np.ndarray], percent: int = 80) -> None:
        self.sets, self.percent, self.sizes = sets, percent, [len(s) for s in sets]
        every = np.concatenate(sets) if sets else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(every, kind="stable")  # owners of a shingle stay in order
        ordered = every[order]
        first = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1]) if len(every) else np.empty(0, np.int64)
        number = np.empty(len(every), dtype=np.int64)
        number[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(every)]])))
        self.owners, self.first, self.stop = owner[order], first, np.concatenate([first[1:], [len(every)]]).astype(np.int64)
        self.lists_of = [np.sort(x) for x in np.split(number, np.cumsum(self.sizes)[:-1])] if sets else []

    def partners(self, q: int, skip) -> Iterator[int]:  # noqa: ANN001
        """Sets that link with set ``q`` and that ``skip`` (asked just before the look-up) doesn't pass over."""
        n = self.sizes[q]
        low = bisect_left(self.sizes, -(-self.percent * n // 100))
        high = bisect_left(self.sizes, 100 * n // self.percent + 1)
        least = -(-self.percent * n // 100)
        mine = self.lists_of[q]
        length = self.stop[mine] - self.first[mine]
        order = np.argsort(length, kind="stable")
        mine, length = mine[order], length[order]
        # Long lists: so many that short ones must still be merged for one occurrence at least.
        long = min(least - 1, int(least / (0.0085 * np.log2(int(length[-1]) + 1) + 1)))
        enough = least - long
        far, some = mine[n - long :], length[: n - long] > 1
        short, length = mine[: n - long][some], length[: n - long][some]
        if not len(short):
            return
        merged = self.owners[np.repeat(self.first[short] - np.cumsum(length) + length, length) + np.arange(length.sum())]
        merged = np.sort(merged[(merged >= low) & (merged < high) & (merged != q)])
        if not len(merged):
            return
        first, last = runs_of(merged)
        counts = last - first + 1
        often = counts >= enough
        for other, count in zip(merged[first[often]].tolist(), counts[often].tolist(), strict=True):
            if skip(other):
                continue
            need = required(n, self.sizes[other], self.percent)
            if count < need <= count + long:
                theirs = self.lists_of[other]
                at = np.minimum(np.searchsorted(theirs, far), len(theirs) - 1)
                count += np.count_nonzero(theirs[at] == far)
            if count >= need:
                yield other


def links(sets: list[np.ndarray], percent: int = 80, labels: list | None = None, sides: list | None = None) -> list[tuple[int, int]]:
    """Links that join the components of the sets (given in order of size); no link within a component.

    ``labels``: sets of one label are joined from the start. ``sides``: sets of one side aren't compared with each other."""
    search, forest, out = DivideSkip(sets, percent), Forest(len(sets)), []
    firsts: dict = {}
    for i, name in enumerate(labels or ()):
        forest.join(firsts.setdefault(name, i), i)
    waiting: dict[int, list[int]] = {}  # of each root, the sets that weren't queries yet
    for i in range(len(sets)):
        waiting.setdefault(forest.root(i), []).append(i)
    heap = [(forest.size[r], r) for r in waiting]
    heapq.heapify(heap)
    skip = lambda q: lambda x: forest.root(x) == forest.root(q) or (sides is not None and sides[x] == sides[q])
    while heap and len(waiting) > 1:
        size, r = heapq.heappop(heap)
        if r not in waiting or forest.size[r] != size:
            continue
        q = waiting[r].pop()
        if not waiting[r]:
            del waiting[r]
        for other in search.partners(q, skip(q)):
            a, b = forest.root(q), forest.root(other)
            forest.join(a, b)
            out.append((q, other))
            both = waiting.pop(a, []) + waiting.pop(b, [])
            if both:
                waiting[forest.root(a)] = both
        r = forest.root(q)
        if r in waiting:
            heapq.heappush(heap, (forest.size[r], r))
    return out


def trees(found: list[tuple[int, int]], nodes: list[int]) -> list[tuple[int, int]]:
    """Each node that ``found`` (pairs of places in ``nodes``) joins to a smaller one, with the smallest of its tree. A node at
    several places may be in several trees."""
    forest = Forest(len(nodes))
    for x, y in found:
        forest.join(x, y)
    least: dict[int, int] = {}
    joined = sorted({i for pair in found for i in pair}, key=nodes.__getitem__)
    pairs = {(nodes[i], least.setdefault(forest.root(i), nodes[i])) for i in joined}
    return sorted((node, top) for node, top in pairs if node != top)


def links_in(rows: DataFrame, keys: tuple[str, ...], percent: int) -> DataFrame:
    """The trees that links make inside each group of ``keys``: ``a`` hangs from ``b``, the smallest node of its tree. Rows have ``node``,
    ``s``, ``lab`` (rows of one label are joined already) and ``side`` (null: compare with all; else with rows of another side only)."""

    def work(table: pa.Table) -> pa.Table:
        begin("jaccard")
        nodes, column = table.column("node").to_numpy(), table.column("s").combine_chunks()
        flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        order = np.lexsort((nodes, [len(s) for s in sets]))
        labels, sides = (table.column(c).take(pa.array(order)).to_pylist() for c in ("lab", "side"))
        found = links([sets[i] for i in order], percent, labels, None if None in sides else sides)
        up = trees(found, nodes[order].tolist())
        return pa.table({"a": pa.array([a for a, _ in up], pa.int64()), "b": pa.array([b for _, b in up], pa.int64())})

    return rows.select(*keys, "node", "s", "lab", "side").groupBy(*keys).applyInArrow(work, "a long, b long")


def blocks_of(rows: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """How many blocks of at most about TASK shingles and ROWS rows each group of ``keys`` makes."""
    size = F.greatest(F.ceil(F.sum("n") / TASK), F.ceil(F.count("*") / ROWS)).cast("int")
    return rows.groupBy(*keys).agg(size.alias(name))


def dealt(rows: DataFrame, salt: int) -> DataFrame:
    """``blocks`` of each row's component and the ``block`` that it is dealt into."""
    sized = rows.join(blocks_of(rows, ("component",), "blocks"), "component")
    return sized.withColumn("block", F.pmod(F.xxhash64("node", "c", F.lit(salt)), F.col("blocks")).cast("int"))


def named(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` after ``edges``, the trees of their representatives: a label gives way to the smallest of its tree."""
    ends = edges.groupBy(F.col("a").alias("lab")).agg(F.min("b").alias("to"))
    return labels.join(ends, "lab", "left").select("component", "node", F.coalesce("to", "lab").alias("lab"))


def search(sets: DataFrame, grouped: DataFrame, percent: int = 80) -> DataFrame:
    """Edges (a, b) between nodes, enough to join each component.

    Rows are dealt into blocks. Inside a block all is compared. A component of several blocks
    goes on with one representative for each tree that was found, dealt anew, until they fit one
    block or hardly any still link. Then its rows have labels; what has the commonest one
    needs no more comparison with its like, only with the rest: blocks of the rest meet
    blocks of all. Where all rows have one label, nothing is left to do."""
    spark = sets.sparkSession
    plain = (F.col("node").alias("lab"), F.lit(None).cast("int").alias("side"))
    first = dealt(sets.join(grouped, "node"), 0)
    large = materialize(first.where("blocks > 1").select("component", "node", "c", "n", "s"), "large-groups")
    edges = [materialize(links_in(first.select("*", *plain), ("component", "block"), percent), "links")]
    if large.isEmpty():
        return edges[0]
    labels = large.select("component", "node", F.col("node").alias("lab")).distinct()
    labels = materialize(named(labels, edges[0]), "labels")
    for salt in range(1, MOST_DEALS):
        chosen = labels.where("node = lab").select("component", "node")
        deal = dealt(large.join(chosen, ["component", "node"]), salt)
        edges.append(materialize(links_in(deal.select("*", *plain), ("component", "block"), percent), "links"))
        seen = deal.agg(F.count("*").alias("rows"), F.max("blocks").alias("blocks")).first()
        moved = edges[-1].count()
        if moved:
            labels = materialize(named(labels, edges[-1]), "labels")
        if seen["blocks"] == 1 or 4 * moved < seen["rows"]:
            break
    counts = labels.groupBy("component", "lab").agg(F.count("*").alias("k"))
    main = counts.groupBy("component").agg(F.max(F.struct("k", "lab"))["lab"].alias("main"), F.count("*").alias("labels")).where("labels > 1")
    rows = large.join(labels, ["component", "node"]).join(main.select("component", "main"), "component").withColumn("rest", F.col("lab") != F.col("main"))
    rest, most = blocks_of(rows.where("rest"), ("component",), "r"), blocks_of(rows.where("not rest"), ("component",), "m")
    sized = rows.join(rest, "component").join(most, "component")
    own = F.pmod(F.xxhash64("node", "c", F.lit(-1)), F.when(F.col("rest"), F.col("r")).otherwise(F.col("m"))).cast("int")
    sized = sized.withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    mine = F.col("own")
    against_main = F.transform(upto("m"), lambda j: place("main", mine, j, F.lit(0)))
    among_rest = F.transform(upto("r"), lambda k: place("rest", F.least(mine, k), F.greatest(mine, k), F.when(mine != k, mine > k)))
    from_main = F.transform(upto("r"), lambda i: place("main", i, mine, F.lit(1)))
    placed = sized.withColumn("at", F.explode(F.when(F.col("rest"), F.concat(against_main, among_rest)).otherwise(from_main)))
    edges.append(links_in(placed.select("component", "at.*", "node", "s", "lab"), ("component", "kind", "i", "j"), percent))
    out = spark.createDataFrame([], "a long, b long")
    for e in edges:
        out = out.unionByName(e)
    return out


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` of every row: the smallest key that links reach."""
    docs = docs.select(F.col(key).cast("long").alias(key), text)
    described = materialize(describe(docs, key, text), "described")
    smallest = described.where(F.col(key).isNotNull() & (F.col("n") > 0)).groupBy("c", "n").agg(F.min(key).alias("node"))
    sets = survivors(docs, described, key, text)
    # A key with several classes ties them together.
    kind = F.struct("c", "n")
    torn = described.where(F.col("n") > 0).groupBy(key).agg(F.min(kind).alias("x"), F.max(kind).alias("y")).where("x != y").select(key)
    tied = described.join(torn, key, "left_semi").join(smallest, ["c", "n"]).select(F.col(key).alias("a"), F.col("node").alias("b"))
    linked = components(search(sets, groups(sets)).union(tied))
    named = smallest.join(linked, "node", "left").select("c", "n", F.coalesce("component", "node").alias("component_id"))
    out = described.join(named, ["c", "n"], "left")
    own = F.when(F.col(key).isNotNull(), F.coalesce("component_id", key))
    return out.select(key, F.col("n").alias("n_shingles"), own.alias("component_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that link, directly or not, to one with a smaller key. Rows without a key stay."""
    found = materialize(join(docs, key, text), "joined")
    return keyed(docs, found.where(F.col("component_id") != F.col(key)).select(key).distinct(), key, "left_anti")
