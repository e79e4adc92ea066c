"""Hard negatives by one-dimensional distance keys.

Vectors get one more component, which brings all of them to the largest length M, and queries
are scaled to that length (their component is 0): then the largest inner product is the
smallest distance, d^2 = 2 M^2 - 2 M s / |q|. Rows are stored sorted by (pivot, distance): the
nearest of ``PIVOTS`` rows, and the distance to it. By the triangle inequality all rows within r
of a query lie in the key interval distance(query, pivot) +- r of each pivot.

The store is cut into shards, ranges of its key, so a pivot with many rows is spread over
several. Queries come in blocks that share a shard of their own; a block goes only to the
shards whose key range meets an interval of one of its queries (an equi-join on the pivot).
There each query scans outwards from its own key: the side whose next row is nearest by key
comes next, and the scan ends when what is left is farther by key than the k-th best row is
in truth. Rounding can't cut a row: bounds are widened by more than the error of the sums.

* Positives: each anchor's own shard gives a first bound, the others what is better.
* Negatives: each positive's score sets the interval of scores that its negatives must have,
  so the lower end is a bound from the start; all positives of an anchor share one scan.

Vectors become whole numbers, floor(scale * x), and scores are exact.

Edge cases: rows with a null id, label or vector, or with a null or not finite component, take
no part. Vectors are compared with vectors of the same length only; of length 0 all score 0.
Rows that repeat an id are candidates each, but never for an anchor of that id; an anchor
that repeats is asked once (the row that comes first by vector and label). Ties go to the
smaller id. A score that a long can't hold is given as the nearest long; ranks and bounds use
the exact one. Fewer rows than asked for: all of them. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .kdsearch import LONG, beyond, exact_kind, largest, scaled, whole_numbers

#: Pivots are chosen among SAMPLE rows (by hash), farthest first: a store needs no more of them when it grows, as shards cut their ranges.
PIVOTS, SAMPLE = 32, 1024
#: Rows of a shard, queries of a block, blocks that a task searches at most, rows of a first step outwards.
SHARD_ROWS, QUERY_ROWS, BATCH_BLOCKS, STEP = 8192, 256, 32, 64
#: Vectors longer than this are not bounded (their squares don't fit a double).
TOO_LONG = 1e100

#: What a query looks for: (lowest score or None, highest score or None), and how many rows.
Target = tuple[int | None, int | None]


def pivot_rows(sample: list[list[float]], scale: int) -> dict[int, list[list[float]]]:
    """Pivots of each length of vectors in the sample: farthest first. Plain numbers; scaled."""
    by_length: dict[int, list[list[float]]] = {}
    for v in sample:
        by_length.setdefault(len(v), []).append(v)
    out = {}
    for n, rows in by_length.items():
        x = np.array(rows, dtype=float).reshape(len(rows), n) * scale
        with np.errstate(over="ignore", invalid="ignore"):
            x = x[np.nan_to_num(np.linalg.norm(x, axis=1), nan=np.inf) < TOO_LONG]
            chosen, away = [], np.full(len(x), np.inf)
            while len(chosen) < min(PIVOTS, len(x)) and away.max() > 0:
                chosen.append(int(away.argmax()))
                away = np.minimum(away, np.linalg.norm(x - x[chosen[-1]], axis=1))
        if chosen:
            out[n] = x[chosen].tolist()
    return out


class Space:
    """Distances to the pivots, after lengthening all vectors to ``longest``."""

    def __init__(self, pivots: dict[int, list[list[float]]], longest: float) -> None:
        self.pivots, self.longest = pivots, longest
        self.bounded = 0 < longest < TOO_LONG

    def of(self, n: int) -> np.ndarray:
        """Pivots of length ``n``; where there are none the origin (lengthened) stands for one."""
        p = self.pivots.get(n) or [[0.0] * n]
        return np.array(p, dtype=float).reshape(len(p), n)

    def margin(self, n: int) -> float:
        """More than the rounding of a difference of two distances."""
        return 1e-6 * self.longest * max(1.0, n / 64) ** 0.5

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """From each row of ``x`` (rows, or queries) to each pivot; 0 where nothing is bounded."""
        p = self.of(x.shape[1])
        if not self.bounded:
            return np.zeros((len(x), len(p)))
        m2 = self.longest**2
        last = lambda v: np.sqrt(np.maximum(0.0, m2 - (v * v).sum(axis=1)))
        if query:
            size = np.sqrt((x * x).sum(axis=1))[:, None]
            cos = np.divide(self.longest * x, size, out=np.zeros_like(x), where=size > 0) @ p.T
        else:
            cos = x @ p.T + last(x)[:, None] * last(p)[None, :]
        return np.sqrt(np.maximum(0.0, 2 * m2 - 2 * cos))

    def reach(self, q: np.ndarray, score: int | None) -> float:
        """The distance within which rows with at least that score lie."""
        size = float(np.sqrt((q * q).sum()))
        if score is None or not self.bounded or size == 0:
            return np.inf
        return float(np.sqrt(max(0.0, 2 * self.longest**2 - 2 * self.longest * (float(score) / size)))) + self.margin(len(q))


class Shard:
    """Rows of one shard, sorted by pivot and distance."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, distances: np.ndarray) -> None:
        order = np.lexsort((ids, distances, pivots))
        self.ids, self.labels, self.vectors, self.distances = ids[order], labels[order], vectors[order], distances[order]
        kinds, starts = np.unique(pivots[order], return_index=True)
        self.runs = list(zip(kinds.tolist(), starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True))
        self.top = largest(self.vectors)
        self._as: dict[type, np.ndarray] = {}

    def outwards(self, to_pivots: np.ndarray, radius: Callable[[], float]) -> Iterator[slice]:
        """Slices of rows, nearest keys first, until all that is left is farther than ``radius()``."""
        heap = []
        for pivot, start, stop in self.runs:
            own = float(to_pivots[pivot])
            at = start + int(np.searchsorted(self.distances[start:stop], own))
            if at < stop:
                heap.append((float(self.distances[at]) - own, at, stop, 1, STEP, own))
            if at > start:
                heap.append((own - float(self.distances[at - 1]), at, start, -1, STEP, own))
        heapq.heapify(heap)
        while heap:
            gap, at, end, way, step, own = heapq.heappop(heap)
            if gap > radius():
                return
            if way > 0:
                stop = min(end, at + step)
                yield slice(at, stop)
                if stop < end:
                    heapq.heappush(heap, (float(self.distances[stop]) - own, stop, end, way, 2 * step, own))
            else:
                start = max(end, at - step)
                yield slice(start, at)
                if start > end:
                    heapq.heappush(heap, (own - float(self.distances[start - 1]), start, end, way, 2 * step, own))

    def search(self, space: Space, own: int, label: int, q: np.ndarray, to_pivots: np.ndarray, same: bool, targets: list[Target], k: int) -> list[list[tuple[int, int]]]:
        """For each target the best (score, id), k at most, of rows of the query's label (or of any other)."""
        kind = exact_kind(self.top * largest(q) * max(1, len(q)))
        if kind not in self._as:
            self._as[kind] = self.vectors.astype(kind)
        vectors, x, floats = self._as[kind], q.astype(kind), q.astype(float)
        best: list[list[tuple[int, int]]] = [[] for _ in targets]
        floors = [low for low, _ in targets]
        wide: list[float] = []

        def radius() -> float:
            if not wide:
                wide.append(max(space.reach(floats, f) for f in floors) if None not in floors else np.inf)
            return wide[0]

        for rows in self.outwards(to_pivots, radius):
            fit = np.flatnonzero(((self.labels[rows] == label) == same) & (self.ids[rows] != own))
            if not len(fit):
                continue
            scores, ids = (vectors[rows] @ x)[fit], self.ids[rows][fit]
            for i, (_, high) in enumerate(targets):
                take = np.ones(len(fit), bool) if floors[i] is None else np.asarray(scores >= floors[i], dtype=bool)
                if high is not None:
                    take &= np.asarray(scores <= high, dtype=bool)
                taken = np.flatnonzero(take)
                if len(taken) > k and kind is not object:
                    taken = taken[np.lexsort((ids[taken], -scores[taken]))[:k]]
                for j in taken:
                    item = (int(scores[j]), -int(ids[j]))
                    if len(best[i]) < k:
                        heapq.heappush(best[i], item)
                    elif item > best[i][0]:
                        heapq.heapreplace(best[i], item)
                if len(best[i]) == k and (floors[i] is None or best[i][0][0] > floors[i]):
                    floors[i] = best[i][0][0]
                    wide.clear()
        return [[(s, -i) for s, i in sorted(b, reverse=True)] for b in best]


def negative_scores(positive: int, low: int = 50, high: int = 95) -> Target:
    """Scores n with low * positive <= 100 * n <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


class Miner:
    """A store of rows by key, and searches of blocks of queries in it."""

    def __init__(self, rows: DataFrame, scale: int) -> None:
        """``rows``: id, label, v, wide."""
        self.scale = scale
        rows = rows.withColumn("n", F.size("v"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)) * scale
        seen = rows.agg(F.count("*").alias("n"), F.max(norm).alias("longest")).first()
        sample = [r["v"] for r in rows.orderBy(F.xxhash64("id", "v")).select("v").limit(SAMPLE).collect()]  # SAMPLE rows at most
        self.space = Space(pivot_rows(sample, scale), float(seen["longest"] or 0.0) * (1 + 1e-12))
        shards = max(1, -(-seen["n"] // SHARD_ROWS))
        by_key = self.by_pivot(rows).repartitionByRange(shards, "n", "wide", "pivot", "distance", "id").withColumn("shard", F.spark_partition_id())
        self.store = materialize(by_key, "negatives-store")
        self.ranges = materialize(self.store.groupBy("n", "pivot", "shard", "wide").agg(F.min("distance").alias("nearest"), F.max("distance").alias("farthest")), "negatives-ranges")

    def by_pivot(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``pivot`` and ``distance``."""
        space, scale = self.space, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sizes = b.column("n").to_numpy()
                vs = b.column("v")
                pivot, distance = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
                for n in np.unique(sizes):
                    at = np.flatnonzero(sizes == n)
                    if n and space.bounded:
                        x = vs.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n) * scale
                        d = space.distances(x, False)
                        pivot[at] = d.argmin(axis=1)
                        distance[at] = d[np.arange(len(at)), pivot[at]]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(distance)], names=[*b.schema.names, "pivot", "distance"])

        return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "pivot int", "distance double"]))

    def blocks(self, asked: DataFrame) -> DataFrame:
        """Queries (n, shard, wide, id, label, v, targets as JSON) packed: one row for each block, with the keys that it needs of each pivot."""
        space, scale = self.space, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, list] = {}
            for b in batches:
                for x in b.to_pylist():
                    held.setdefault((x["shard"], x["part"], x["n"], x["wide"]), []).append(x)
            for (shard, part, n, wide), items in held.items():
                q = np.array([x["v"] for x in items], dtype=float).reshape(len(items), n)
                d = space.distances(q * scale, True)
                reach = []
                for x, v in zip(items, q, strict=True):
                    lows = [low for low, _ in json.loads(x["targets"])]
                    reach.append(max(space.reach(v * scale, f) for f in lows) if lows and None not in lows else np.inf)
                r = np.array(reach)[:, None] + space.margin(n)
                keys = [{"pivot": p, "low": float(low), "high": float(high)} for p, (low, high) in enumerate(zip((d - r).min(axis=0), (d + r).max(axis=0), strict=True))]
                data = json.dumps([[x["id"], x["label"], json.loads(x["targets"])] for x in items])
                yield pa.RecordBatch.from_pydict({"block": [f"{shard}:{part}:{n}:{wide}"], "shard": pa.array([shard], pa.int32()), "n": pa.array([n], pa.int32()), "asked_wide": [wide], "queries": [data], "vs": [q.tobytes()], "keys": pa.array([keys], KEYS)})

        return asked.repartition("shard", "part", "n", "wide").mapInArrow(run, "block string, shard int, n int, asked_wide boolean, queries string, vs binary, keys array<struct<pivot int, low double, high double>>")

    def routes(self, blocks: DataFrame, home: bool) -> DataFrame:
        """``block``, ``to`` (a shard) and ``wide``: where a block must be searched; ``home``: in its own shard only, else in all others."""
        keys = blocks.select("block", "n", F.col("shard").alias("own"), F.explode("keys").alias("k")).select("block", "n", "own", "k.*")
        on = F.col("own") == F.col("shard") if home else F.col("own") != F.col("shard")
        met = keys.join(self.ranges, ["n", "pivot"]).where(on & (F.col("farthest") >= F.col("low")) & (F.col("nearest") <= F.col("high")))
        return met.select("block", F.col("shard").alias("to"), "wide").distinct()

    def searched(self, blocks: DataFrame, routes: DataFrame, same: bool, k: int) -> DataFrame:
        """``id``, ``target`` (its number), ``found``, ``score``, ``beyond`` and ``exact`` (the score as text)."""
        space, scale = self.space, self.scale
        batches = max(1, -(-blocks.count() // BATCH_BLOCKS))
        sent = blocks.select("block", "n", "asked_wide", "queries", "vs").join(routes, "block").withColumn("batch", F.pmod(F.xxhash64("block"), F.lit(batches)).cast("int"))
        sent = sent.select(F.col("to").alias("shard"), "n", "wide", "batch", "asked_wide", "queries", "vs")
        # A shard is read once for each batch of blocks that needs it.
        needed = sent.select(*(F.col(c).alias(c) for c in ("shard", "n", "wide", "batch"))).distinct()
        rows = self.store.select("shard", "n", "wide", "id", "label", "v", "pivot", "distance").join(needed, ["shard", "n", "wide"])

        def search(key: tuple, rows: pa.Table, sent: pa.Table) -> pa.Table:
            n, wide = key[1].as_py(), key[2].as_py()
            out: list[tuple] = []
            if len(rows) and len(sent):
                v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)
                shard = Shard(*(rows.column(c).to_numpy() for c in ("id", "label")), scaled(v, scale, wide), *(rows.column(c).to_numpy() for c in ("pivot", "distance")))
                for queries, vs, far in zip(*(sent.column(c).to_pylist() for c in ("queries", "vs", "asked_wide")), strict=True):
                    queries = json.loads(queries)
                    q = np.frombuffer(vs, np.float64).reshape(len(queries), n)
                    to_pivots, q = space.distances(q * scale, True), scaled(q, scale, far)
                    to_pivots = to_pivots if n else np.zeros((len(queries), 1))
                    for (own, label, targets), x, d in zip(queries, q, to_pivots, strict=True):
                        found = shard.search(space, own, label, x, d, same, [tuple(t) for t in targets], k)
                        out += [(own, t, i, min(max(s, LONG.min), LONG.max), beyond(s), str(s)) for t, best in enumerate(found) for s, i in best]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) or [()] * 6
            return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "target", "found", "score", "beyond", "exact"])

        by = ("shard", "n", "wide", "batch")
        return rows.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(search, "id long, target int, found long, score long, beyond string, exact string")


KEYS = pa.list_(pa.struct([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query and target, with ``rank``."""
    by_score = Window.partitionBy("id", "target").orderBy(F.desc("score"), F.desc("beyond"), "found", "exact")
    return found.withColumn("rank", F.row_number().over(by_score).cast("int")).where(F.col("rank") <= k)


def mine(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    For each row for which ``anchors`` holds and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's."""
    df = df.where(F.col(label).isNotNull())
    part = df.select(F.col(key).alias("key_"), F.col(vector).alias("v_"), F.struct(F.col(label).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asked")).alias("own_"))
    rows = whole_numbers(part, scale, "key_", "v_", ("own_",)).select("id", "v", "wide", "own_.*")
    miner = Miner(materialize(rows, "negatives-rows"), scale)
    one = F.min(F.struct("v", "label", "n", "shard", "wide")).alias("x")
    asked = materialize(miner.store.where("asked").groupBy("id").agg(one).select("id", "x.*"), "negatives-asked")
    # Blocks of a shard's queries: as many parts as its fullest needs.
    most = asked.groupBy("shard").count().agg(F.max("count")).first()[0] or 1
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(-(-most // QUERY_ROWS))).cast("int"))

    start = miner.blocks(asked.withColumn("targets", F.lit("[[null, null]]")))
    start = materialize(start, "negatives-blocks")
    home = materialize(miner.searched(start, miner.routes(start, home=True), True, positives), "negatives-home")
    kth = first_of(home, positives).where(F.col("rank") == positives).select("id", F.concat(F.lit("[["), "exact", F.lit(", null]]")).alias("targets"))
    bounded = asked.join(kth, "id", "left").withColumn("targets", F.coalesce("targets", F.lit("[[null, null]]")))
    again = materialize(miner.blocks(bounded), "negatives-blocks")
    others = miner.searched(again, miner.routes(again, home=False), True, positives)
    best = materialize(first_of(home.unionByName(others), positives).select("id", "rank", "found", "score", "exact"), "negatives-positives")

    to_json = F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), x["low"], F.lit(", "), x["high"], F.lit("]"))), ", "), F.lit("]"))
    limits = with_limits(best, low, high)
    wanted = limits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("p")).select("id", to_json.alias("targets"))
    last = materialize(miner.blocks(asked.join(wanted, "id")), "negatives-blocks")
    both = miner.routes(last, home=True).unionByName(miner.routes(last, home=False))
    found = first_of(miner.searched(last, both, False, negatives), negatives)
    return found.join(best.select("id", (F.col("rank") - 1).alias("target"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), ["id", "target"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def with_limits(best: DataFrame, low: int, high: int) -> DataFrame:
    """``low`` and ``high`` as text: the scores that negatives of each positive may have; whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [negative_scores(int(s), low, high) for s in b.column("exact").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rank"), *(pa.array([str(e[i]) for e in ends], pa.string()) for i in (0, 1))], names=["id", "rank", "low", "high"])

    return best.select("id", "rank", "exact").mapInArrow(run, "id long, rank int, low string, high string")


#: The query's rows over ``embeddings``.
ORACLE_SQL = """with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from (
  select anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
  from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score) where rank <= 3"""
