r"""Chat formatting: budgeted windows over conversations, with a mask of what to learn.

A turn is written as ``<|im_start|>role\ntext<|im_end|>\n``. Control strings inside texts
are escaped reversibly: between ``<`` and ``|`` (with any backslashes between them) one
more backslash is put, so ``<|`` never stands inside a text; reading back takes it away.
In roles ``%`` and line feeds are percent-encoded besides.

Tokens are estimated as a quarter of a turn's UTF-8 bytes, rounded up. Prefix sums of these
over a conversation choose turn-aligned spans: the line of tokens is cut into strides; a
span holds the turns that lie in one stride, and a turn that crosses the end of a stride
is a span of its own. So a span is at most one stride long, or one turn. A window is the
conversation's system turn (if it begins with one), as many whole turns before the span as
fit into ``history`` tokens, and the span. Only assistant texts of the span are under the
loss mask: repeated turns are masked, so each text is learned once.

Prefix sums are taken in two levels, over blocks of turn numbers and within them, so the
turns of one long conversation are not all sorted in one task. All is DataFrame
expressions; no Python runs on the executors.

Edge cases: null texts and roles are empty; null turn numbers come first, equal ones are
ordered by role and text; repeated rows are turns each; rows with a null conversation form
one conversation. A turn longer than the budget makes a window of its own, which is then
over budget (``tokens`` tells). An empty table gives no window. Only the named columns of
the input are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a span, and of the history before it at most.
STRIDE, HISTORY = 512, 256
#: Turn numbers in a block of the prefix sums.
TURNS = 64


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def turns(conversations: DataFrame) -> DataFrame:
    """One row for each turn: its place, the written head and text, and where its tokens begin and end."""
    c = conversations
    rows = c.select(c["conv_id"], c["turn"], F.floor(c["turn"] / TURNS).alias("block"), F.coalesce(c["role"], F.lit("")).alias("role"), F.coalesce(c["text"], F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", "block", "role", "text", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("tokens", F.ceil(F.octet_length(F.concat("head", "body", F.lit(END + "\n"))) / 4).cast("long"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns({"upto": F.sum("tokens").over(inside), "nth": F.count("*").over(inside)})
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    joined = within.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    return joined.select("conv_id", (F.col("n0") + F.col("nth")).alias("place"), "role", "head", "body", "tokens", (F.col("t0") + F.col("upto") - F.col("tokens")).alias("begin"))


def windows(conversations: DataFrame, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """``conv_id``, ``window``, ``formatted``, ``loss`` (array of start and length, in
    characters), ``context`` (how many turns in front are repeated), ``n_turns`` (of the
    span) and ``tokens``."""
    if history > stride:
        raise ValueError("history is longer than a stride")
    rows = turns(conversations)
    slot = F.floor(F.col("begin") / stride)
    crossing = F.col("begin") + F.col("tokens") > (slot + 1) * stride
    late = F.col("begin") >= (slot + 1) * stride - history
    uses = F.array(
        F.struct((2 * slot + crossing.cast("long")).alias("window"), F.lit(True).alias("own")),
        F.when(~crossing, F.struct((2 * slot + 1).alias("window"), F.lit(False).alias("own"))),
        F.when(late, F.struct((2 * slot + 2).alias("window"), F.lit(False).alias("own"))),
        F.when(late, F.struct((2 * slot + 3).alias("window"), F.lit(False).alias("own"))),
    )
    used = rows.withColumn("use", F.explode(F.filter(uses, lambda u: u.isNotNull()))).select("*", "use.*").where(F.col("own") | (F.col("tokens") <= history))
    item = F.struct("place", "own", "role", "head", "body", "tokens", "begin")
    grouped = used.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(item)).alias("items"), F.min(F.when(F.col("own"), F.col("begin"))).alias("first")).where("first is not null")
    near = grouped.withColumn("items", F.filter("items", lambda i: i["own"] | (i["begin"] >= F.col("first") - history)))
    system = rows.where("place = 1 and role = 'system'").select(F.col("conv_id").alias("c"), F.struct("place", F.lit(False).alias("own"), "role", "head", "body", "tokens", "begin").alias("system"))
    near = near.join(system, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    led = F.when(F.col("system").isNull() | (F.col("items")[0]["place"] == 1), F.col("items")).otherwise(F.concat(F.array("system"), F.col("items")))
    full = near.select("conv_id", "window", led.alias("items"))
    text = lambda i: F.concat(i["head"], i["body"], F.lit(END + "\n"))
    span = lambda at, i: F.struct((at + F.length(i["head"])).alias("start"), F.length(i["body"]).alias("length"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    learnt = lambda a, i: F.when(i["own"] & (i["role"] == "assistant"), F.concat(a["spans"], F.array(span(a["at"], i)))).otherwise(a["spans"])
    mask = F.aggregate("items", nothing, lambda a, i: F.struct((a["at"] + F.length(text(i))).alias("at"), learnt(a, i).alias("spans")), lambda a: a["spans"])
    return full.select(
        "conv_id",
        "window",
        F.array_join(F.transform("items", text), "").alias("formatted"),
        mask.alias("loss"),
        F.size(F.filter("items", lambda i: ~i["own"])).alias("context"),
        F.size(F.filter("items", lambda i: i["own"])).alias("n_turns"),
        F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i["tokens"]).alias("tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """From windows: ``turns`` (array of role and text, the span's own) and ``learned`` (text under the mask), unescaped."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    own = F.slice(pieces, F.col("context") + 1, F.size(pieces) - 1 - F.col("context"))
    turn = lambda p: F.substr(p, F.lit(len(START) + 1))
    parsed = F.transform(F.transform(own, turn), lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text")))
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.withColumns({"turns": parsed, "learned": learned})


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its windows."""
    read = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", said.alias("said"), "learned"))).alias("w"), F.sum(F.size("turns")).alias("n_turns"), F.sum(F.length("formatted")).alias("formatted_chars"))
    turns_text, loss_text = F.array_join(F.col("w.said"), ""), F.array_join(F.col("w.learned"), "")
    return whole.select("conv_id", "n_turns", F.sha2(turns_text, 256).alias("turns_sha256"), F.length(loss_text).cast("long").alias("loss_chars"), F.sha2(loss_text, 256).alias("loss_sha256"), "formatted_chars")


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one, -1, whose texts are control strings."""
    said = f"{END}{START}assistant ok"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


#: The same rows by another way: plain prefix sums, and joins for history and system turns.
ORACLE_SQL = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{END}{START}assistant ok'
  union all select -1, 1, 'assistant', '{END}{START}assistant ok'),
e as (
  select *, regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g') as r,
         regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as t from c),
s as (
  select *, length(r) + length(t) + {len(START) + len(END) + 2} as chars,
         (strlen(r) + strlen(t) + {len(START) + len(END) + 2} + 3) // 4 as tokens,
         row_number() over (partition by conv_id order by turn nulls first, role, text) as place from e),
p as (select *, cast(sum(tokens) over (partition by conv_id order by place) - tokens as bigint) as b from s),
w as (select *, 2 * (b // {STRIDE}) + case when b + tokens > (b // {STRIDE} + 1) * {STRIDE} then 1 else 0 end as span from p),
g as (select conv_id, span, min(b) as first_b, min(place) as first_place, sum(chars) as chars from w group by 1, 2),
h as (
  select g.conv_id, g.span, coalesce(sum(w.chars), 0) as chars, min(w.place) as first_place
  from g left join w on g.conv_id = w.conv_id and w.b < g.first_b and w.b >= g.first_b - {HISTORY} group by 1, 2),
y as (select conv_id, chars from w where place = 1 and role = 'system'),
f as (
  select g.conv_id, sum(g.chars + h.chars + case when g.first_place > 1 and coalesce(h.first_place, 2) > 1 then coalesce(y.chars, 0) else 0 end) as formatted_chars
  from g join h using (conv_id, span) left join y on g.conv_id = y.conv_id group by 1),
d as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
         coalesce(string_agg(text, '' order by place) filter (where role = 'assistant'), '') as learned from s group by 1)
select d.conv_id, n_turns, turns_sha256, cast(length(learned) as bigint) as loss_chars, sha256(learned) as loss_sha256,
       cast(formatted_chars as bigint) as formatted_chars
from d join f using (conv_id)
"""
