"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token counts are raked:
scaled so that the sums over each source match the sources' targets, then the languages',
then the topics', again and again, until a round finds every sum within ``TOLERANCE`` of its
target (or ``ROUNDS`` rounds are over: targets that no weights on the cells can meet are
never met; ``calibrate`` says in ``off`` how far the last round was). A cell's calibrated
weight over its share of tokens is its rate. A budget of 1 asks for as many tokens as there
are. There are two ways to take a sample, both by a hash of the key, so that a run on the
same rows takes the same documents:

* ``copies`` meets the calibrated weights in expectation with any budget: a document comes
  ``budget`` times its cell's rate, the whole part for sure and the rest by a draw. Copies
  of one document are made from its row, so all in one task.
* ``kept`` takes no document twice: it marks those with a copy at least. A cell that is
  wanted more than it has is kept whole and what it lacks is missing, so the weights are met
  only with a budget under the inverse of the largest rate.

All is DataFrame expressions. Documents are pre-aggregated to cells before anything is
shuffled. Up to ``FEW`` cells are raked in one task; of more, a side's sums are partial sums
that join back to the cells, so neither all cells nor those of one language meet in a task.
The cells come back to the documents by a broadcast of at most ``BROADCAST`` rows, else by
a shuffled join.

Targets: for each of the three, shares by value; values that no document has are left out
and the rest scaled to 1. Without given targets, the corpus' own shares to the power
``TEMPER``, which lifts what is rare.

Topic here is the shape of a text: short, listing, long or prose (``topic_of``); another
column expression can be given. Tokens are estimated as a quarter of the UTF-8 bytes,
rounded up.

Edge cases: null sources and languages are values of their own (''), null texts are empty:
0 tokens, topic short, and a cell without tokens keeps all its documents, once. Null keys hash as
''. Repeated rows are kept or dropped together. An empty table gives an empty result. Input
columns named like result columns are replaced, all others come back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, materialize

ROUNDS, TOLERANCE, TEMPER, BROADCAST = 60, 1e-5, 0.5, 100_000
#: Up to so many cells are raked in one task, so many rounds for each table written; more by sums and joins, round by round.
FEW, AT_ONCE = 50_000, 5
SIDES = ("source", "lang", "topic")


def topic_of(text: str = "text") -> Column:
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(F.length(t) < 400, "short").when(lines * 60 > F.length(t), "listing").when(F.length(t) > 8000, "long").otherwise("prose")


def tokens_of(text: str = "text") -> Column:
    return F.ceil(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / 4).cast("long")


def targets(cells: DataFrame, side: str, given: dict[str, float] | None = None, temper: float = TEMPER) -> DataFrame:
    """``side`` and ``target``: a share for each value that has tokens; one row for each value."""
    sums = cells.where("tokens > 0").groupBy(side).agg(F.sum("tokens").cast("double").alias("t"))
    if given is None:
        raw = F.pow("t", F.lit(temper))
    else:
        raw = F.element_at(F.create_map(*(F.lit(x) for kv in given.items() for x in (kv[0], float(kv[1])))), F.col(side))
    weighed = sums.select(side, raw.alias("raw")).where("raw > 0")
    total = weighed.agg(F.sum("raw")).first()[0]
    return weighed.select(side, (F.col("raw") / F.lit(total)).alias("target"))


def scaled(side: str, total: Column) -> tuple[Column, Column]:
    """A cell's weight scaled to the target of its value of ``side``, whose sum is ``total``; and how far that was."""
    to, reached = F.col(f"to_{side}"), total > 0
    return F.when(reached, F.col("weight") * to / total).otherwise(0.0), F.when(reached, F.abs(total / to - 1)).otherwise(0.0)


def rounds_in_one_task(live: DataFrame, rounds: int, tolerance: float) -> DataFrame:
    """Some rounds over at most ``FEW`` cells; none changes a weight after one that is near enough."""
    now, own = live.coalesce(1), [F.col(c) for c in live.columns if c not in ("weight", "off")]
    for _ in range(rounds):
        away, before = F.lit(0.0), F.col("weight")
        for side in SIDES:  # one select for a side: each is analysed anew, so fewer are faster
            weight, far = scaled(side, F.sum("weight").over(Window.partitionBy(side)))
            now = now.select(*own, "off", before.alias("before"), weight.alias("weight"), F.greatest(away, far).alias("away"))
            away, before = F.col("away"), F.col("before")
        going = F.col("off") > tolerance
        last = F.max("away").over(Window.partitionBy(F.lit(0)))
        now = now.select(*own, F.when(going, F.col("weight")).otherwise(before).alias("weight"), F.when(going, last).otherwise(F.col("off")).alias("off"))
    return now


def round_by_sums(live: DataFrame) -> DataFrame:
    """One round over any number of cells: partial sums of each side join back to its cells."""
    now, own = live, [F.col(c) for c in live.columns if c not in ("weight", "off")]
    for side in SIDES:
        sums = now.groupBy(side).agg(F.sum("weight").alias("sum"))
        weight, far = scaled(side, F.col("sum"))
        now = now.join(sums, side).select(*own, weight.alias("weight"), (far if side == SIDES[0] else F.greatest("off", far)).alias("off"))
    return now


def calibrate(cells: DataFrame, given: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, budget: float = 1.0, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``weight`` (raked share of tokens), ``rate``, ``probability`` (the rate, at most 1) and ``off``: the largest relative distance from a target that the last round found."""
    marked = cells
    for side in SIDES:
        marked = marked.join(targets(cells, side, (given or {}).get(side)).withColumnRenamed("target", f"to_{side}"), side, "left")
    wanted = F.least(*(F.coalesce(f"to_{s}", F.lit(0.0)) for s in SIDES)) > 0
    start = {"weight": F.when(wanted, F.col("tokens").cast("double")).otherwise(0.0), "off": F.lit(float("inf"))}
    live = materialize(marked.where("tokens > 0").withColumns(start), "cells")
    few = live.limit(FEW + 1).count() <= FEW
    off, done = float("inf"), 0
    while done < rounds and off > tolerance:
        n = min(AT_ONCE, rounds - done) if few else 1
        live = materialize(rounds_in_one_task(live, n, tolerance) if few else round_by_sums(live), "raked")
        done += n
        off = live.agg(F.max("off")).first()[0] or 0.0
    whole = live.agg(F.sum("weight").alias("weight"), F.sum("tokens").alias("tokens")).first()
    share = F.col("weight") / F.lit(whole["weight"]) / (F.col("tokens") / F.lit(whole["tokens"]))
    rate = F.lit(budget) * share if whole["weight"] else F.lit(0.0)
    return live.withColumn("rate", rate).select(*SIDES, "tokens", "weight", F.least(F.lit(1.0), "rate").alias("probability"), "rate", F.lit(off).alias("off"))


def mix(docs: DataFrame, given: dict[str, dict[str, float]] | None = None, topic: Column | None = None, key: str = "doc_id", text: str = "text", seed: str = "", budget: float = 1.0) -> DataFrame:
    """``docs`` with ``topic``, ``tokens``, ``probability`` and ``kept``, ``rate`` and ``copies``."""
    own = [c for c in docs.columns if c.lower() not in ("topic", "tokens", "probability", "kept", "rate", "copies")]
    source, lang = free_name(docs, "m_source"), free_name(docs, "m_lang")
    marked = docs.withColumns({"topic": topic_of(text) if topic is None else topic, "tokens": tokens_of(text), source: F.coalesce("source", F.lit("")), lang: F.coalesce("lang", F.lit(""))})
    cells = marked.groupBy(F.col(source).alias("source"), F.col(lang).alias("lang"), "topic").agg(F.sum("tokens").alias("tokens"))
    cells = materialize(cells, "cell-sums")
    rates = materialize(calibrate(cells, given, budget=budget).select(F.col("source").alias(source), F.col("lang").alias(lang), "topic", "probability", "rate"), "cell-rates")
    few = rates.limit(BROADCAST + 1).count() <= BROADCAST
    joined = marked.drop("probability", "rate").join(F.broadcast(rates) if few else rates, [source, lang, "topic"], "left")
    chance = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    p = F.round(F.coalesce("probability", F.lit(1.0)), 9)
    rate = F.round(F.coalesce("rate", F.lit(1.0)), 9)
    times = F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")
    return joined.select(*own, "topic", "tokens", p.alias("probability"), (chance < p).alias("kept"), rate.alias("rate"), times.alias("copies"))


def oracle() -> str:
    """DuckDB SQL for ``rate`` and ``copies`` of mix() over documents with the default targets."""
    inner = f"(select *, 0.0 as away from r where k < {ROUNDS} and off > {TOLERANCE})"
    for s in SIDES:
        inner = f"(select *, sum(w) over (partition by {s}) as total from {inner})"
        inner = f"(select * exclude (w, away, total), w * to_{s} / total as w, greatest(away, abs(total / to_{s} - 1)) as away from {inner})"
    target = lambda s: f"pow(sum(tokens) over (partition by {s}), {TEMPER}) / (select sum(pow(t, {TEMPER})) from (select sum(tokens) as t from w0 group by {s})) as to_{s}"
    return f"""with recursive d as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(text, '') as t from documents),
m as (select doc_id, source, lang, case when length(t) < 400 then 'short' when (length(t) - length(replace(t, chr(10), ''))) * 60 > length(t) then 'listing' when length(t) > 8000 then 'long' else 'prose' end as topic, (strlen(t) + 3) // 4 as tokens from d),
w0 as (select source, lang, topic, cast(sum(tokens) as double) as tokens from m group by all having sum(tokens) > 0),
r as (
  select 0 as k, source, lang, topic, tokens, {", ".join(target(s) for s in SIDES)}, tokens as w, 1e300 as off from w0
  union all
  select k + 1, source, lang, topic, tokens, to_source, to_lang, to_topic, w, max(away) over () from {inner}),
f as (select source, lang, topic, (w / sum(w) over ()) / (tokens / sum(tokens) over ()) as rate from r where k = (select max(k) from r)),
c as (select doc_id, m.source, m.lang, m.topic, cast(tokens as bigint) as tokens, round(coalesce(rate, 1.0), 9) as rate, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) / 4294967296.0 as chance from m left join f using (source, lang, topic))
select doc_id, source, lang, topic, tokens, round(rate, 6) as rate, cast(floor(rate) + (chance < rate - floor(rate))::int as bigint) as copies from c"""
