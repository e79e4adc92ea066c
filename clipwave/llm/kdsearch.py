"""Exact top-k search by inner product with k-d trees, one for each shard.

Candidates are dealt into shards of about ``SHARD_ROWS`` rows; each shard builds a tree:
the widest dimension is split at its median until leaves hold ``LEAF_ROWS`` rows, and every
node keeps the tight box of its rows. Queries come in blocks of ``QUERY_ROWS``, packed into
one row each, and every block meets every shard: the stated query set against all rows, in blocks.

Within a shard a query walks the tree best-first: the node whose box allows the largest
inner product comes next, and the walk ends when no box allows more than the k-th best
score so far. That k-th score is propagated: in a first round each query searches one
shard only; what it finds there is its bound in all others, so they start with it.
Bounds only ever cut boxes that can't hold a better or an equal score, so results are exact.

Vectors become whole numbers first, floor(scale * x). Products are computed with doubles or
64 bits where these hold every sum exactly; vectors with larger components ("wide" ones)
stand in trees of their own and are multiplied as whole numbers of any size.

Edge cases: vectors that are null, or hold a null or a component that isn't finite, take no
part, nor do rows without an id. Vectors are only compared with vectors of the same length
(of length 0: score 0). Ties go to the smaller id. Rows that repeat an id are candidates
each; all rows with a query's own id are left out for it; a query that repeats is answered
once (the row that comes first by vector). A score that a long can't hold is given as the
nearest long; its rank is still the exact one. Fewer than k candidates: all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: A task holds one shard and at most BATCH_BLOCKS blocks of queries.
SHARD_ROWS, QUERY_ROWS, BATCH_BLOCKS, LEAF_ROWS = 4096, 512, 32, 32
#: A vector with a larger component, after scaling, is wide.
MOST = 1 << 27
LONG = np.iinfo(np.int64)


class KdTree:
    """Rows (ids, vectors of int64) in leaf order, with a tight box for each node."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order]
        place = np.arange(len(ids))
        self.low, self.high, self.children, self.rows = [], [], [], []

        def build(start: int, stop: int) -> int:
            v = self.vectors[place[start:stop]]
            low, high = v.min(axis=0), v.max(axis=0)
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.children.append(None)
            self.rows.append((start, stop))
            if stop - start > LEAF_ROWS and v.shape[1] and (high > low).any():
                axis = int((high - low).argmax())
                half = (stop - start) // 2
                place[start:stop] = place[start:stop][np.argpartition(v[:, axis], half)]
                self.children[node] = (build(start, start + half), build(start + half, stop))
            return node

        if len(ids):
            build(0, len(ids))
        self.ids, self.vectors = self.ids[place], self.vectors[place]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.top = largest(self.vectors)
        self._as: dict[type, list[np.ndarray]] = {}

    def arrays(self, kind: type) -> list[np.ndarray]:
        """Vectors and boxes as numbers of ``kind``."""
        if kind not in self._as:
            self._as[kind] = [x.astype(kind) for x in (self.vectors, self.low, self.high)]
        return self._as[kind]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, bounds: list[int | None]) -> Iterator[list[tuple[int, int]]]:
        """For each query its best (score, id), at most k, that can count beside its bound."""
        if not len(self.ids):
            yield from ([] for _ in ids)
            return
        kind = exact_kind(self.top * largest(queries) * max(1, queries.shape[1]))
        q, (vectors, low, high) = queries.astype(kind), self.arrays(kind)
        most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T  # a box's largest inner product
        for i, own in enumerate(ids):
            best: list[tuple[int, int]] = []  # a heap: the worst of the best comes first; ids are negated
            floor = bounds[i]
            heap = [(-most[i, 0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                limit = best[0][0] if len(best) == k else None
                limit = floor if limit is None else limit if floor is None else max(limit, floor)
                if limit is not None and -bound < limit:
                    break
                if self.children[node] is not None:
                    for c in self.children[node]:
                        if limit is None or most[i, c] >= limit:
                            heapq.heappush(heap, (-most[i, c], c))
                    continue
                start, stop = self.rows[node]
                scores = vectors[start:stop] @ q[i]
                for j in np.flatnonzero(scores >= limit) if limit is not None else range(stop - start):
                    if (other := int(self.ids[start + j])) != own:
                        item = (int(scores[j]), -other)
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
            yield [(s, -n) for s, n in sorted(best, reverse=True)]


def largest(v: np.ndarray) -> int:
    """The largest absolute value, as a whole number of any size."""
    return max((abs(int(x)) for x in (v.max(initial=0), v.min(initial=0))), default=0) if v.size else 0


def exact_kind(most: int) -> type:
    """Numbers that hold sums up to ``most`` exactly; doubles are the fastest."""
    return np.float64 if most < 2**52 else np.int64 if most < 2**62 else object


def scaled(parts: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x) of what ``whole_numbers`` gave."""
    return np.array([int(x * scale) if abs(x) < 2.0**900 else int(x) * scale for x in parts.ravel()], dtype=object).reshape(parts.shape) if wide else np.rint(parts * scale).astype(np.int64)


def beyond(score: int) -> str | None:
    """Text that puts scores which a long can't hold in order; null for all others."""
    if LONG.min < score < LONG.max:
        return None
    digits = str(abs(score))
    text = f"{len(digits):05d}{digits}"
    return text if score > 0 else "".join(str(9 - int(c)) for c in text) + "~"


def whole_numbers(df: DataFrame, scale: int, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id`` and ``v`` of the rows that take part: floor(scale * x) / scale, which doubles hold
    exactly as ``scale`` is a power of two; and ``wide``: whether a component is over MOST. Columns of ``keep`` stay."""
    if scale & (scale - 1):
        raise ValueError("the scale must be a power of two")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    part = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))))
    v = F.transform(vector, lambda x: x.cast("double"))
    # From 2^44 on a double is whole after scaling by any power of two that is allowed here.
    low = F.transform(v, lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * scale) / float(scale)).otherwise(x) + 0.0)
    return part.select(F.col(key).cast("long").alias("id"), low.alias("v"), F.exists(low, lambda x: F.abs(x) > MOST / scale).alias("wide"), *keep)


def top_k(df: DataFrame, queries: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row for which ``queries`` holds, the k rows with the largest inner products."""
    # Of rows that repeat id and vector no more than k can be among the best k.
    copies = whole_numbers(df, scale, key, vector).groupBy("id", "v", "wide").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
    rows = copies.select("id", "v", "wide", F.size("v").alias("n"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    asked = whole_numbers(df.where(queries), scale, key, vector).groupBy("id").agg(F.min(F.struct("v", "wide")).alias("x")).select("id", "x.*", F.size("x.v").alias("n"))
    seen = rows.agg(F.count("*").alias("n"), F.max("wide").alias("wide")).first()
    count, some_wide, count_asked = seen["n"], bool(seen["wide"]), asked.count()
    shards, blocks = max(1, -(-count // SHARD_ROWS)), max(1, -(-count_asked // QUERY_ROWS))
    batches = -(-blocks // BATCH_BLOCKS)
    # Shards by id, vector and copy, so a hot vector or id is spread.
    placed = rows.select(F.pmod(F.xxhash64("id", "v", "copy"), F.lit(shards)).cast("int").alias("shard"), "n", "wide", "id", "v")
    home = asked.select(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int").alias("block"), "n", "id", "v", "wide")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block into one binary row, per task: ids, bounds and vectors."""
        held: dict[tuple[int, int, bool], list] = {}
        for b in batches:
            for block, n, wide, i, v, bound in zip(*(b.column(c).to_pylist() for c in ("block", "n", "wide", "id", "v", "bound")), strict=True):
                held.setdefault((block, n, wide), []).append((i, bound, v))
        for (block, n, wide), items in held.items():
            ids = np.array([x[0] for x in items], dtype=np.int64)
            floor = np.array([LONG.min if x[1] is None else x[1] for x in items], dtype=np.int64)
            v = np.array([x[2] for x in items], dtype=np.float64).reshape(len(items), n)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "n": pa.array([n], pa.int32()), "asked_wide": [wide], "ids": [ids.tobytes()], "floors": [floor.tobytes()], "vs": [v.tobytes()]})

    def search(pairs: tuple, trees: pa.Table, sent: pa.Table) -> pa.Table:
        n, wide = pairs[1].as_py(), pairs[2].as_py()
        ids = trees.column("id").to_numpy()
        v = trees.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), n) if len(ids) else np.empty((0, n))
        tree = KdTree(ids, scaled(v, scale, wide))
        out: list[tuple[int, int, int, str | None]] = []
        for a, f, w, far in zip(*(sent.column(c).to_pylist() for c in ("ids", "floors", "vs", "asked_wide")), strict=True):
            asked_ids = np.frombuffer(a, np.int64)
            floors = [None if x == LONG.min else int(x) for x in np.frombuffer(f, np.int64)]
            asked_v = scaled(np.frombuffer(w, np.float64).reshape(len(asked_ids), n), scale, far)
            for q, best in zip(asked_ids, tree.search(asked_ids, asked_v, k, floors), strict=True):
                out += [(int(q), i, min(max(s, LONG.min), LONG.max), beyond(s)) for s, i in best]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score", "beyond"])

    packed_schema = "block int, n int, asked_wide boolean, ids binary, floors binary, vs binary"
    found_schema = "query_id long, vec_id long, score long, beyond string"

    def packed(q: DataFrame) -> DataFrame:
        return q.repartition(blocks, "block").mapInArrow(pack, packed_schema)

    def searched(sent: DataFrame) -> DataFrame:
        trees = placed.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
        sent = sent.withColumn("batch", F.floor(F.col("block") / BATCH_BLOCKS).cast("int"))
        sent = sent.withColumn("wide", F.explode(F.array(F.lit(False), F.lit(True)) if some_wide else F.array(F.lit(False))))
        return trees.groupBy("shard", "n", "wide", "batch").cogroup(sent.groupBy("shard", "n", "wide", "batch")).applyInArrow(search, found_schema)

    # First round: each block in one shard, for a lower bound of each query's k-th score.
    first = packed(home.withColumn("bound", F.lit(None).cast("long"))).withColumn("shard", F.pmod(F.hash("block"), F.lit(shards)).cast("int"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    kth = searched(first).groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("worst")).where(F.col("found") == k).select(F.col("query_id").alias("id"), F.col("worst").alias("bound"))
    bounded = materialize(home.join(kth, "id", "left").select("block", "n", "wide", "id", "v", "bound"), "topk-bounds")
    # Second round: every block in every shard.
    sent = packed(bounded).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    best = searched(sent).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
