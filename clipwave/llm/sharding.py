"""Sharding by k-d tree partitioning.

Rows become points whose dimensions are metadata of their text: its size (on a log scale),
and its shares of multi-byte characters, of line ends and of blanks. A node of the tree
stands for a number of shards; it is split along its widest dimension at the weighted median
of bytes (at the matching quantile where its number of shards is odd), until each leaf is
one shard, which then holds its share of all bytes: the target bytes, where they are given.
How wide a node is along a dimension is the spread of its bytes there (their standard
deviation) as a part of the root's, so no unit makes a dimension wide.

Coordinates are whole numbers of 63 bits: 24 of the dimension, then 20 of the text's checksum
and 19 of the key's hash, which only order rows of one place. Rows of equal text stand
together, and a cut always falls between texts, at the nearer edge of the text that holds the
median; so all rows of a text are in one shard. A text whose rows outweigh a shard gets
one of its own, and the others share what is left evenly. A cut is found by histograms: bytes
are summed over ``BINS`` bins of each node, the bin that holds the median is cut into bins
again, until it holds one text, or under ``TOLERANCE`` of a shard. Only the open nodes (fewer than the
shards), their bins and texts that outweigh a shard ever reach the driver; rows are summed where they are.

Slots are numbered without gaps in two levels, over fixed buckets of keys and within them,
so no task sorts a whole shard. Rows of one key and text are numbered in parts by where they
are read, so that many of them don't meet in one task.

Edge cases: a null text has no bytes and the checksum of nothing; size counts 8 more bytes
for each row, so such rows have weight too. Rows that are equal in key and text as well
share all coordinates: they stay in one shard. An empty table gives no rows. Clashing columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

BINS = 1024
#: Most bytes that lie on the wrong side of a cut, as a share of a shard's, apart from those of a text that isn't cut.
TOLERANCE = 1e-4
#: Coordinates of one text.
TEXT = 1 << 19
#: Rows of a bucket in which slots are numbered.
BUCKET_ROWS = 20_000
DIMENSIONS = ("by_size", "by_script", "by_lines", "by_blanks")


def points(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``size``, ``text_crc32`` and a coordinate for each of DIMENSIONS."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda c: F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit("")))
    base = docs.select(F.col(key), F.octet_length(t).cast("long").alias("bytes"), F.length(t).cast("long").alias("chars"), F.crc32(t.cast("binary")).alias("text_crc32"), count("\n").alias("lines"), count(" ").alias("blanks"))
    tie = F.shiftleft(F.col("text_crc32") % (1 << 20), 19) + F.pmod(F.xxhash64(key, "text_crc32"), F.lit(1 << 19))
    at = lambda share: F.shiftleft(F.least(F.lit((1 << 24) - 1), F.greatest(F.lit(0), F.floor(share * (1 << 24)))).cast("long"), 39) + tie
    coordinates = (
        at(F.log2(F.col("bytes") + 8.0) / 40),
        at((F.col("bytes") - F.col("chars")) / (F.col("bytes") + 1.0)),
        at(F.sqrt(F.col("lines") / (F.col("chars") + 1.0))),
        at(F.col("blanks") / (F.col("chars") + 1.0)),
    )
    return base.select(key, (F.col("bytes") + 8).alias("size"), "text_crc32", *(c.alias(n) for c, n in zip(coordinates, DIMENSIONS, strict=True)))


def of_node(values: list[int], kind: str = "long") -> Column:
    """The value that belongs to the row's node."""
    return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("node") + 1)


def coordinate(nodes: list[dict]) -> Column:
    """The row's coordinate along the axis of its node."""
    return F.element_at(F.array(*DIMENSIONS), of_node([n["axis"] + 1 for n in nodes], "int"))


def spread(r, d: int) -> float:  # noqa: ANN001
    """Standard deviation of a node's bytes along dimension ``d``."""
    mean = r[f"s{d}"] / r["w"]
    return max(0.0, r[f"q{d}"] / r["w"] - mean * mean) ** 0.5


def cut_nodes(rows: DataFrame, nodes: list[dict], root: list[float]) -> None:
    """Find the axis and the cut of each node that stands for more than one shard. ``root``: the root's spreads, which the first call fills in."""
    sums = []
    for i, d in enumerate(DIMENSIONS):
        x = F.shiftright(d, 39) / float(1 << 24)
        sums += [F.min(d).alias(f"lo{i}"), F.max(d).alias(f"hi{i}"), F.sum(F.col("size") * x).alias(f"s{i}"), F.sum(F.col("size") * x * x).alias(f"q{i}")]
    found = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *sums).collect()}  # a row for each node
    if not root and found:
        root += [spread(found[0], d) for d in range(len(DIMENSIONS))]
    for i, n in enumerate(nodes):
        n |= {"axis": 0, "cut": (1 << 63) - 1, "low": 0, "high": 1, "below": 0, "done": True}
        if (r := found.get(i)) and n["count"] > 1:
            wide = [spread(r, d) / root[d] if root[d] > 0 else 0.0 for d in range(len(DIMENSIONS))]
            n["axis"] = max(range(len(DIMENSIONS)), key=lambda d, w=wide: round(w[d], 9))
            n |= {"low": r[f"lo{n['axis']}"] // TEXT * TEXT, "high": r[f"hi{n['axis']}"] + 1, "weight": r["w"], "want": r["w"] * (n["count"] // 2) / n["count"], "wide": wide, "done": False}
    while not all(n["done"] for n in nodes):
        for n in nodes:
            width = n["high"] - n["low"]
            n["step"] = max(1, -(-width // BINS // TEXT)) * TEXT
        value = rows.where(of_node([not n["done"] for n in nodes], "boolean")).select("node", "size", coordinate(nodes).alias("value"), *(of_node([n[x] for n in nodes]).alias(x) for x in ("low", "high", "step")))
        bins = value.where("value >= low and value < high").groupBy("node", F.expr("(value - low) div step").alias("bin")).agg(F.sum("size").alias("w"))
        held: dict[int, list] = {}
        for b in bins.collect():  # at most BINS rows for each open node
            held.setdefault(b["node"], []).append((b["bin"], b["w"]))
        for i, bars in held.items():
            n, upto = nodes[i], nodes[i]["below"]
            for k, w in sorted(bars):
                if upto + w >= n["want"]:
                    left, right = n["low"] + k * n["step"], n["low"] + (k + 1) * n["step"]
                    if n["step"] == TEXT or w <= TOLERANCE * n["weight"] / n["count"]:
                        n |= {"cut": right if upto + w - n["want"] <= n["want"] - upto else left, "done": True}
                    else:
                        n |= {"low": left, "high": min(n["high"], right), "below": upto}
                    break
                upto += w


def heavy_texts(rows: DataFrame, shards: int) -> DataFrame | None:
    """Texts that outweigh an even share of what is left beside heavier ones, with ``own``: a shard for each, the last ones. None if there is no such text."""
    at = [F.shiftright(d, 19).alias(f"at_{d}") for d in DIMENSIONS]
    texts = materialize(rows.groupBy("text_crc32", *at).agg(F.sum("size").alias("w")), "shard-texts")
    total, found = texts.agg(F.sum("w")).first()[0] or 0, []
    while len(found) < shards - 1:
        share = (total - sum(r["w"] for r in found)) / (shards - len(found))
        # The share only shrinks as they go, so who was over it stays so: fewer than the shards.
        over = texts.where(F.col("w") > share).orderBy(F.desc("w"), *texts.columns[:-1]).limit(shards - 1).collect()
        if len(over) == len(found):
            break
        found = over
    if not found:
        return None
    return rows.sparkSession.createDataFrame([(*r[:-1], shards - 1 - i) for i, r in enumerate(found)], ", ".join([*(f"{c} long" for c in texts.columns[:-1]), "own int"]))


def partition(rows: DataFrame, shards: int, tree: list[dict] | None = None) -> DataFrame:
    """``rows`` with ``shard``: a shard each for heavy texts, the others level by level, all nodes of a level at once. ``tree`` takes up the nodes that were split."""
    heavy = heavy_texts(rows, shards)
    if heavy is None:
        return split(rows, shards, tree)
    at = {f"at_{d}": F.shiftright(d, 19) for d in DIMENSIONS}
    marked = materialize(rows.withColumns(at).join(heavy, ["text_crc32", *at], "left").select(*rows.columns, "own"), "shard-heavy")
    light = split(marked.where("own is null").select(*rows.columns), shards - heavy.count(), tree)
    return light.select(*rows.columns, "shard").unionByName(marked.where("own is not null").select(*rows.columns, F.col("own").alias("shard")))


def split(rows: DataFrame, shards: int, tree: list[dict] | None = None) -> DataFrame:
    """``rows`` with ``shard``, from a tree of cuts."""
    rows, nodes, root = rows.withColumn("node", F.lit(0)), [{"first": 0, "count": shards}], []
    while any(n["count"] > 1 for n in nodes):
        cut_nodes(rows, nodes, root)
        if tree is not None:
            tree += [n for n in nodes if "wide" in n]
        below: list[dict] = []
        for n in nodes:
            half = n["count"] // 2
            parts = [(n["first"], half), (n["first"] + half, n["count"] - half)] if half else [(n["first"], 1)]
            n["left"], n["right"] = len(below), len(below) + len(parts) - 1
            below += [{"first": f, "count": c} for f, c in parts]
        right = coordinate(nodes) >= of_node([n["cut"] for n in nodes])
        rows = rows.withColumn("node", F.when(right, of_node([n["right"] for n in nodes], "int")).otherwise(of_node([n["left"] for n in nodes], "int")))
        rows = materialize(rows, "shard-nodes")  # a level's choice isn't worked out again by those below it
        nodes = below
    return rows.withColumn("shard", of_node([n["first"] for n in nodes], "int"))


def shard(docs: DataFrame, shards: int | None = 24, key: str = "doc_id", text: str = "text", target_bytes: int | None = None, tree: list[dict] | None = None) -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row. With ``target_bytes`` there are as many shards as bring each under it, else ``shards``."""
    rows = materialize(points(docs, key, text), "shard-points")
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("w")).first()
    if target_bytes:
        shards = max(1, -(-(total["w"] or 0) // target_bytes))
    placed = partition(rows, shards, tree).select(key, "size", "text_crc32", "shard")
    buckets = max(1, total["n"] // BUCKET_ROWS)
    # Hashed with the text too, and dealt by where they are read: rows that repeat a key are spread as well.
    at = F.pmod(F.xxhash64(key, "text_crc32", F.shiftright(F.monotonically_increasing_id(), 33)), F.lit(buckets))
    placed = materialize(placed.withColumn("bucket", at), "shard-placed")
    inside = Window.partitionBy("shard", "bucket").orderBy(key, "text_crc32")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = placed.withColumn("nth", F.row_number().over(inside)).join(counts, ["shard", "bucket"])
    return numbered.select(key, "size", "text_crc32", "shard", (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"))
