"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is *bound*: the vectors of its
letters, rotated by two, one and no places, are multiplied. A text is *bundled*: the
vectors of its trigrams are added. A language's prototype is the bundle of all its
training texts. A text gets the language whose prototype has the largest cosine with it.
``centre`` takes off the part that all prototypes have in common before they are compared.

A letter is any character that Unicode calls one, lower-cased; everything else is one and
the same gap, so trigrams also see where words begin and end. Letters of the Latin
alphabet have places of their own in the letter table, others are dealt to the remaining
places by a fixed hash.

Training: each task adds up, for each language, how often each trigram occurs in a slice
of its texts, and turns the counts into one vector (bundling is linear, so that is the
bundle of these texts). A task adds up its own vectors, Spark those of all tasks. Only one vector for each
language reaches the driver; more than ``MOST_LANGUAGES`` is an error.

Rejecting: cosines of texts in no learned language are small but seldom under 0. ``floors``
finds, from the labelled texts that get their own language, the score and the margin that all
but ``FLOOR_SHARE`` of them reach, for each class of length (short texts score low);
``known`` says whether a text reaches both. Labelled junk counts as a labelled text, so
more than that share of it lowers the floors; and a few random letters may score like a real
text of a few letters. A class without such texts gets the floors of all classes.

Edge cases: a text that is null, or has no letter, gets ``und`` and score 0. Rows with a
null language don't train. Whole texts count, in blocks, so very long ones need no more
memory. Equal cosines: the language that comes first in the alphabet. With no training
text at all every document gets ``und``. Repeated rows give repeated results. Clashing
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, begin, give_back, map_slices, slices

UNKNOWN = "und"
DIMENSIONS = 1024
#: Places in the letter table: the gap, 26 Latin letters, and the hashed rest.
PLACES = 128
MOST_LANGUAGES = 1000
#: Characters that are looked at together.
BLOCK = 1 << 20
#: Share of correctly identified labelled texts that may fall under a floor; floors are whole steps of 1/STEPS.
FLOOR_SHARE, STEPS = 0.001, 1000
#: Characters at which the next class of length begins.
LENGTHS = (100, 1000)


@lru_cache(maxsize=1)
def place_of_letter() -> np.ndarray:
    """Place of each code point in the letter table; 0 is the gap."""
    points = np.arange(0x110000, dtype=np.uint64)
    place = (27 + (points * np.uint64(2654435761) >> np.uint64(11)) % np.uint64(PLACES - 27)).astype(np.uint8)
    place[ord("a") : ord("z") + 1] = np.arange(1, 27)
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    place[~letter] = 0
    return place


@lru_cache(maxsize=4)
def letter_vectors(dimensions: int) -> list[np.ndarray]:
    """The letter table rotated by two, one and no places."""
    table = np.random.default_rng(17).choice(np.array([-1, 1], dtype=np.float32), size=(PLACES, dimensions))
    return [np.roll(table, k, axis=1) for k in (2, 1, 0)]


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Codes of the trigrams of a text, in blocks; runs of gaps count as one."""
    place = place_of_letter()
    text = " " + text.lower() + " "
    rest = np.empty(0, dtype=np.uint8)
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "replace"), dtype=np.uint32)
        p = np.concatenate([rest, place[points]])
        keep = np.ones(len(p), dtype=bool)
        keep[1:] = (p[1:] != 0) | (p[:-1] != 0)
        keep[: len(rest)] = True
        p = p[keep].astype(np.int32)
        if len(p) >= 3:
            codes = (p[:-2] * PLACES + p[1:-1]) * PLACES + p[2:]
            yield codes[p[1:-1] != 0] if len(codes) else codes
        rest = p[-2:].astype(np.uint8)


def bundles(groups: list[list[np.ndarray]], dimensions: int) -> np.ndarray:
    """One bundle for each group of trigram codes: counts times bound vectors."""
    codes = [c for g in groups for c in g]
    out = np.zeros((len(groups), dimensions), dtype=np.float32)
    if not sum(map(len, codes)):
        return out
    every = np.concatenate(codes)
    owner = np.repeat(np.arange(len(groups)), [sum(map(len, g)) for g in groups])
    seen = np.zeros(PLACES**3, dtype=bool)
    seen[every] = True
    kinds = np.flatnonzero(seen)
    column = np.zeros(PLACES**3, dtype=np.int32)
    column[kinds] = np.arange(len(kinds))
    two, one, none = letter_vectors(dimensions)
    step = 2048  # bound vectors in use at a time
    for at in range(0, len(kinds), step):
        k = kinds[at : at + step]
        here = (column[every] >= at) & (column[every] < at + step) if len(kinds) > step else slice(None)
        counts = np.bincount(owner[here] * len(k) + column[every[here]] - at, minlength=len(groups) * len(k)).reshape(len(groups), len(k))
        bound = two[k // PLACES**2] * one[k // PLACES % PLACES]
        bound *= none[k % PLACES]
        out += counts.astype(np.float32) @ bound
    return out


@dataclass
class Profiles:
    languages: list[str]
    vectors: np.ndarray  # one row for each language

    def directions(self, centre: bool = False) -> np.ndarray:
        """Prototypes of length 1; with ``centre``, less the mean of all of them."""
        v = self.vectors / np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-12)
        if centre and len(v) > 1:
            v = v - v.mean(axis=0)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return v


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None, dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes of all languages of ``docs`` (rows for which ``where`` holds)."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), (F.lit(True) if where is None else where).alias("own"))
    rows = rows.where("own and lang is not null and text is not null").select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid")
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches):
            groups: dict[str, list[np.ndarray]] = {}
            for n, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                groups.setdefault(n, []).extend(trigrams(t))
            for n, v in zip(groups, bundles(list(groups.values()), dimensions).astype(np.float64), strict=True):
                sums[n] = sums[n] + v if n in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["lang", "bundle"])
        give_back()

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    places = rows.mapInArrow(run, "lang string, bundle array<double>").select("lang", F.posexplode("bundle").alias("at", "x"))
    total = places.groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("bundle"))
    found = total.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    found = sorted((r for r in found if any(r["bundle"])), key=lambda r: r["lang"])
    return Profiles([r["lang"] for r in found], np.array([r["bundle"] for r in found]).reshape(len(found), dimensions))


def identify(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text", centre: bool = False, keep: bool = False) -> DataFrame:
    """``key``, ``lang_pred``, ``score`` (the cosine, not under 0) and ``margin`` (to the runner-up)
    of every text; with ``keep``, all columns of ``docs`` and these."""
    docs = docs.drop("lang_pred", "score", "margin") if keep else docs.select(key, text)
    own = docs.columns if keep else [key]
    names, dimensions = profiles.languages, profiles.vectors.shape[1]
    ways = profiles.directions(centre).astype(np.float32)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        groups = [list(trigrams(t)) if t else [] for t in part.column(text).to_pylist()]
        made = np.concatenate([bundles(groups[i : i + 128], dimensions) for i in range(0, len(groups), 128)])
        length = np.linalg.norm(made, axis=1)
        pred, score, margin = [UNKNOWN] * len(groups), np.zeros(len(groups)), np.zeros(len(groups))
        if names:
            cosines = (made @ ways.T) / np.maximum(length, 1e-12)[:, None]
            best = cosines.argmax(axis=1)
            lettered = [any(map(len, g)) for g in groups]
            pred = [names[i] if ok else UNKNOWN for i, ok in zip(best, lettered, strict=True)]
            top = np.sort(cosines, axis=1)
            score = np.where(lettered, np.clip(top[:, -1], 0, 1), 0).astype(np.float64)
            margin = np.where(lettered, top[:, -1] - (top[:, -2] if len(names) > 1 else 0), 0).astype(np.float64)
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(pred, pa.string()), pa.array(score), pa.array(margin)], names=[*own, "lang_pred", "score", "margin"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own), "lang_pred string", "score double", "margin double"])
    return map_slices(docs, work, schema, text, "langid")


def length_class(text: str = "text") -> Column:
    n = F.coalesce(F.length(text), F.lit(0))
    return sum((F.when(n >= least, 1).otherwise(0) for least in LENGTHS), F.lit(0))


def step_of(measure: str) -> Column:
    return F.floor(F.col(measure) * STEPS)


def floors(found: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[int]]:
    """Least steps of ``score`` and ``margin`` for each class of length, from identified texts with their columns. Only counts by step reach the driver."""
    right = found.where(F.col(text).isNotNull() & (F.col(lang).cast("string") == F.col("lang_pred"))).withColumn("size", length_class(text))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), step_of(m).alias("step")) for m in ("score", "margin")))).alias("m")
    counts = right.select("size", each).groupBy("size", "m.measure", "m.step").count().collect()

    def least(found: list) -> int | None:
        total, seen = sum(r["count"] for r in found), 0
        for r in sorted(found, key=lambda r: r["step"]):
            seen += r["count"]
            if seen > FLOOR_SHARE * total:
                return r["step"]
        return None

    out = {}
    for measure in ("score", "margin"):
        mine = [r for r in counts if r["measure"] == measure]
        every = least(mine) or 0
        by_size = [least([r for r in mine if r["size"] == k]) for k in range(len(LENGTHS) + 1)]
        out[measure] = [every if x is None else x for x in by_size]
    return out


def known(least: dict[str, list[int]], text: str = "text") -> Column:
    """Whether an identified text is in a learned language; over the columns of ``identify``."""
    reached = [step_of(m) >= F.element_at(F.array(*map(F.lit, steps)), length_class(text) + 1) for m, steps in least.items()]
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0) & reached[0] & reached[1]
