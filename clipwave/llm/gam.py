"""Quality classifier: a generalised additive model with pairwise interactions.

The log-odds of a text are a sum of look-up tables: one over the bins of each feature and
a few over pairs of features. The tables are learned by cyclic boosting: feature after
feature, round after round, a shallow tree (at most four leaves) is fitted to the current
gradient over the feature's bins and added, shrunk, to its table. After that, the pairs whose trees promise most
are boosted in the same way over their bin grids. Scoring a slice of texts is a binary search for the bins and
vectorised additions of table entries.

The model is fitted on the driver with at most about ``MOST_TRAINING_ROWS`` labelled rows
(features only, never texts): labels are drawn by a hash of the key, and of what they bring,
however often a key repeats, distinct rows of features by their hash. Scoring covers all rows.

Edge cases: a null text is an empty one and has a score as any other. Repeated labels of a
document count as their mean; null labels don't count. Without any label the score is 0.5,
with labels of one class only it is near that class. Rows that are equal in
features and label train once; every row is scored. Only the named columns of the input are read, so clashing
extra columns do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, training_rows
from .textstats import FIELDS, measure

#: About the most labelled rows that a fit looks at.
MOST_TRAINING_ROWS = 40_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, SMOOTH = 48, 12, 6, 120, 0.15, 5.0

NAMES = ("log_words", "chars_per_word", "symbols", "upper", "digits", "exclaims", "dup_lines", "repeats", "distinct", "line_words", "stops", "not_ascii")


def features(texts: list[str | None]) -> np.ndarray:
    """One row of NAMES for each text: sizes on a log scale, the others as shares."""
    v = dict(zip(FIELDS, np.array([measure(t) for t in texts], dtype=np.float64).reshape(-1, len(FIELDS)).T, strict=True))
    words, chars = np.maximum(v["n_words"], 1), np.maximum(v["word_chars"], 1)
    return np.column_stack([
        np.log1p(v["n_words"]), v["word_chars"] / words, v["n_symbols"] / chars, v["n_upper"] / chars, v["n_digits"] / chars, v["n_exclaim"] / chars,
        v["n_dup_lines"] / np.maximum(v["n_lines"], 1), v["n_repeat_words"] / words, v["n_distinct_words"] / words, v["n_words"] / np.maximum(v["n_lines"], 1), v["n_stops"] / words, (v["n_bytes"] - v["n_chars"]) / chars,
    ])


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain of the best cut of a row of bins, and the first bin right of it (0: none)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + SMOOTH) + right_g**2 / (right_h + SMOOTH) - g.sum() ** 2 / (h.sum() + SMOOTH)
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to four leaves over a row of bins: its step for each bin."""
    out = np.zeros(len(g))
    _, middle = best_cut(g, h)
    cuts = [0, *([best_cut(g[:middle], h[:middle])[1], middle, middle + best_cut(g[middle:], h[middle:])[1]] if middle else []), len(g)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            out[a:b] = RATE * g[a:b].sum() / (h[a:b].sum() + SMOOTH)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The better of the trees that cut one side first and then, in each half, the other; with its gain."""
    found = (0.0, np.zeros(g.shape))
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        gain, at = best_cut(gg.sum(axis=1), hh.sum(axis=1))
        at = at or len(gg) // 2
        out, total = np.zeros(gg.shape), gain
        for rows in (slice(0, at), slice(at, None)):
            more, cut = best_cut(gg[rows].sum(axis=0), hh[rows].sum(axis=0))
            total += more
            for cols in (slice(0, cut), slice(cut, None)):
                if gg[rows, cols].size:
                    out[rows, cols] = RATE * gg[rows, cols].sum() / (hh[rows, cols].sum() + SMOOTH)
        if total > found[0]:
            found = (total, out.T if turn else out)
    return found


@dataclass
class Gam:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, k], side="right")]
        coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.pair_edges)]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of all features, then of the most promising pairs."""
    if not len(y):
        return Gam()
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Gam(base=float(np.log(share / (1 - share))))
    model.edges = [edges_of(c, BINS) for c in x.T]
    model.pair_edges = [edges_of(c, PAIR_BINS) for c in x.T]
    fine = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, t in enumerate(model.tables):
            g, h = gradient()
            step = tree(np.bincount(fine[k], g, len(t)), np.bincount(fine[k], h, len(t)))
            t += step
            f += step[fine[k]]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        cell = coarse[a] * shape[1] + coarse[b]
        g, h = gradient()
        return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    d = x.shape[1]
    gains = sorted(((pair_tree(*grid(a, b)[1:])[0], a, b) for a in range(d) for b in range(a + 1, d)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(ROUNDS // 4):
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            cell, g, h = grid(a, b)
            step = pair_tree(g, h)[1]
            t += step
            f += step.ravel()[cell]
    return model


def learn(docs: DataFrame, labels: DataFrame, where: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = MOST_TRAINING_ROWS) -> Gam:
    """Fit on labelled documents; ``where`` is a condition on the labels' rows."""
    rows = labels if where is None else labels.where(where)
    rows = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.avg(label).alias("label"))
    share = most_rows / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)))
    known = docs.select(key, text).join(F.broadcast(rows), key).select(F.col(text).alias("text"), "label")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        x = features(part.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), part.column("label")], names=[*NAMES, "label"])

    found = training_rows(map_slices(known, work, ", ".join(f"{n} double" for n in (*NAMES, "label")), "text", "gam"), most_rows, "gam-training")
    x = np.column_stack([found.column(n).to_numpy() for n in NAMES])
    y = (found.column("label").to_numpy() >= 0.5).astype(np.float64)
    order = np.lexsort((y, *x.T))  # the order in which tasks ended doesn't matter
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Gam, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """``key`` and ``score`` of every text; with ``keep``, all columns of ``docs`` and ``score``."""
    docs = docs.drop("score") if keep else docs.select(key, text)
    names = docs.columns if keep else [key]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "score double"])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        p = model.score(features(part.column(text).to_pylist()))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(p)], names=[*names, "score"])

    return map_slices(docs, work, schema, text, "gam")
