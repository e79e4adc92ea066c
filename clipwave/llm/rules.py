"""Quality rules: a learned decision list over counts of a text.

Sequential covering in the manner of RIPPER: a rule is a conjunction of thresholds on
whole-number features. It is *grown* on one part of the labelled rows, adding the
threshold with the highest information gain until it covers no good text; *pruned* on the
rest, dropping last thresholds as long as that makes it no worse; and kept if it is
precise over all of them together. The bad texts that it covers are taken away and the next rule is grown.
The list is emitted as one ordered Spark conditional expression (``verdict``), so applying
it needs no Python beyond the counting of words and lines.

Features are shares in thousandths (whole numbers), computed by the same Spark expressions
for learning and for applying.

Edge cases: a null text is an empty one: all counts 0, so it fails the base rules. Without
labels, or without labels of both classes, the list is empty and keeps all that passes the
base rules. Repeated labels of a document count as their mean, null labels don't. Rows that
are equal in features and label train once, and at most about ``MOST_TRAINING_ROWS`` train,
however often a key repeats. Ties
between thresholds: the first feature, then the smallest threshold. Only the named columns
of the input are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import training_rows
from .textstats import measure_documents

#: About the most labelled rows that learning looks at.
MOST_TRAINING_ROWS = 40_000
#: Most rules, most thresholds in one, and the least share of bad texts among those a rule covers.
MOST_RULES, MOST_CONDITIONS, PRECISION = 12, 4, 0.95

#: Name, numerator and denominator: thousandths, rounded down.
SHARES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "distinct": ("n_distinct_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "exclaims": ("n_exclaim", "word_chars"),
    "stops": ("n_stops", "n_words"),
    "line_words": ("n_words", "n_lines"),
}


def share(name: str) -> Column:
    top, bottom = SHARES[name]
    return F.expr(f"1000L * {top} div greatest({bottom}, 1L)")


def base_failed() -> Column:
    """The fixed rules: under 50 words, or over half of them in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > threshold, else feature <= threshold
    threshold: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return (x[self.feature] > self.threshold) == self.above

    def column(self) -> Column:
        return share(self.feature) > self.threshold if self.above else share(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < MOST_CONDITIONS:
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p0 or not n0:
            break
        best: tuple[float, Condition] | None = None
        for name, column in x.items():
            values, at = np.unique(column[inside], return_inverse=True)
            if len(values) < 2:
                continue
            p_low, n_low = np.cumsum(np.bincount(at, bad[inside]))[:-1], np.cumsum(np.bincount(at, ~bad[inside]))[:-1]
            middle = (values[:-1] + values[1:]) // 2
            for above, p, n in ((True, p0 - p_low, n0 - n_low), (False, p_low, n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                k = int(gain.argmax())
                if best is None or gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(name, above, int(middle[k])))
        if best is None or best[0] <= 1e-9:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        c = covers(r, x, len(bad))
        p, n = int(bad[c].sum()), int((~bad[c]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        """True keeps a text: the first rule that holds rejects it."""
        if not self.rules:
            return F.lit(True)
        out = None
        for rule in self.rules:
            hit = rule[0].column()
            for c in rule[1:]:
                hit = hit & c.column()
            out = F.when(hit, False) if out is None else out.when(hit, False)
        return out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join([*("reject if " + " and ".join(map(str, r)) for r in self.rules), "else keep"])


def fit(x: dict[str, np.ndarray], bad: np.ndarray, growing: np.ndarray) -> DecisionList:
    """``growing`` marks the rows that rules grow on; the others prune."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    some = lambda rows: {k: v[rows] for k, v in x.items()}
    while len(rules) < MOST_RULES and bad[left & growing].any() and not bad[left].all():
        g, p = left & growing, left & ~growing
        rule = grow(some(g), bad[g])
        if not rule:
            break
        rule = prune(rule, some(p), bad[p]) if p.any() else rule
        hit = covers(rule, x, len(bad)) & left
        if not bad[hit].any() or bad[hit].mean() < PRECISION:
            break
        rules.append(rule)
        left &= ~(hit & bad)
    return DecisionList(rules)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", where: Column | None = None, most_rows: int = MOST_TRAINING_ROWS) -> DecisionList:
    """Learn from labelled documents that pass the base rules; ``where`` is a condition on the labels' rows."""
    rows = labels if where is None else labels.where(where)
    rows = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.avg(label).alias("label"))
    part = most_rows / max(1, rows.count())
    if part < 1:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(part * (1 << 20)))
    known = measure_documents(docs.select(key, text).join(F.broadcast(rows), key), key, text, ("label",)).where(~base_failed())
    rows = known.select("label", (F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) != 0).alias("growing"), *(share(n).alias(n) for n in SHARES))
    table = training_rows(rows, most_rows, "rules-training")
    x = {n: table.column(n).to_numpy() for n in SHARES}
    return fit(x, table.column("label").to_numpy() < 0.5, table.column("growing").to_numpy(zero_copy_only=False).astype(bool))


def apply(docs: DataFrame, rules: DecisionList, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, all counts, ``base_failed`` and ``kept`` of every text."""
    return measure_documents(docs, key, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.verdict())
