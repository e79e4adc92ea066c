"""All queries by name, with the DuckDB SQL that gives the same rows.

Recording concepts are mapped onto the driver's tables: a user's events are a channel's
samples in order of time, an embedding is a window of samples, brands and nations are
contact labels, labelled documents are annotated clips whose score is their length.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions.dsp import butter_band, run_sections
from ..operators import channels as C
from ..operators import evaluation as V
from ..operators import patterns as P
from ..operators import recurrence as R
from ..operators import signal as G
from ..operators import stimulation as D
from ..sources import segments as X
from ..sources import tables as T
from ..sources.shared import new_path, written
from . import clips as clips_of
from . import studies

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

HOUR = 3600.0


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from ..streaming import queries as _stream  # noqa: F401  registers the detectors' queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: ``chan``, ``event_id``, ``event_type``, ``x``, ``t`` (seconds) and ``i``."""
    since = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1e6
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("chan"), "event_id", "event_type", F.col("value").alias("x"), since.alias("t"))
    return G.numbered(e, "chan", "t", "event_id")


EV = """ev as (
  select user_id as chan, event_id, event_type, value as x, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as t,
         row_number() over (partition by user_id order by ts, event_id) - 1 as i from events)"""
WIN = EV + """, w as (
  select chan, event_id, event_type, x, t, i, i // 5 as win from (select *, count(*) over (partition by chan) as n from ev) where (i // 5 + 1) * 5 <= n)"""
LL = WIN + """, l as (
  select chan % 10 as clip, chan, win, coalesce(sum(step), 0.0) as ll
  from (select *, abs(x - lag(x) over (partition by chan, win order by i)) as step from w) group by 1, 2, 3)"""
BASE = LL + """, k as (
  select * from (select *, row_number() over (partition by clip, chan order by ll) as r, count(*) over (partition by clip, chan) as n from l where win < 6)
  where r <= greatest(1, floor(n * 0.8 + 1e-9))),
med as (select clip, chan, median(ll) as med, count(*) as n_baseline from k group by 1, 2),
mad as (select k.clip, k.chan, median(abs(ll - med)) as mad from k join med using (clip, chan) group by 1, 2)"""
ZED = BASE + f""", g as (select clip, median(med) as gmed from med group by 1),
z as (select l.clip, l.chan, l.win, (ll - med) / (greatest(1.4826 * mad, 0.25 * gmed) + {S.EPS}) as z, l.win % 7 <> 3 as valid
  from l join med using (clip, chan) join mad using (clip, chan) join g using (clip) where l.win >= 6)"""
RUN = ZED + """, m as (
  select clip, chan, win, case when n = 3 then low else -'inf'::double end as run_min from (
    select clip, chan, win, min(case when valid then z else -'inf'::double end) over f as low, count(*) over f as n
    from z window f as (partition by clip, chan order by win rows between current row and 2 following))),
s as (select clip, run_min as score, case when run_min > -'inf'::double then chan end as chan, case when run_min > -'inf'::double then win end as onset_win
  from (select *, row_number() over (partition by clip order by run_min desc, chan, win) as r from m) where r = 1)"""


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tumble(samples(spark, sf_dir), 5)


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.line_length(windowed(spark, sf_dir)).withColumn("clip", F.col("chan") % 10)


def z_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ll = lengths(spark, sf_dir)
    base = G.robust_baseline(ll.where("win < 6"), keys=("clip",))
    return G.z_scores(ll.where("win >= 6"), base).select("clip", "chan", "win", "z", (F.col("win") % 7 != 3).alias("valid"))


# Labels and channels


@query("select c_custkey, regexp_replace(c_name, '^([^0-9]*)0', '\\1') as label from customer")
def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", S.normalize_label(F.col("c_name")).alias("label"))


NATION = "c as (select replace(n_name, '_', '') as label, regexp_extract(replace(n_name, '_', ''), '([A-Za-z]+)([0-9]+)', 1) as e, cast(regexp_extract(replace(n_name, '_', ''), '([A-Za-z]+)([0-9]+)', 2) as integer) as k from nation)"


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.replace("n_name", F.lit("_"), F.lit("")).alias("label"))


@query(f"with {NATION} select a.label as first, b.label as second from c a join c b on a.e = b.e and b.k = a.k + 1")
def bipolar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pairs(nations(spark, sf_dir)).select("first", "second")


@query(f"with {NATION} select a.label, b.label as alt from c a left join c b on a.e = b.e and b.k = a.k + 1")
def alt_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.partners(nations(spark, sf_dir)).select("label", "alt")


BRANDS = ("Brand3", "Brand17", *C.NOT_CONTACTS)


@query(f"select p_partkey, replace(p_brand, '#', '') as label from part where replace(p_brand, '#', '') not in {BRANDS}")
def exclude_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.without(read(spark, sf_dir, "part").select("p_partkey", F.replace("p_brand", F.lit("#"), F.lit("")).alias("label")), BRANDS)


@query(
    f"""with {NATION}, p as (select a.label, a.k, b.label as alt from c a left join c b on a.e = b.e and b.k = a.k + 1)
select label, alt from p where starts_with(label, 'NATION') and label not in ('NATION3', 'NATION4') and coalesce(alt, '') not in ('NATION3', 'NATION4') and k < 11"""
)
def eligible_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.eligible(nations(spark, sf_dir), ("NATION3", "NATION4"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("label"))


@query("select distinct replace(p_brand, '#', '') as label, cast(regexp_extract(p_brand, '[0-9]+') as integer) as number from part")
def electrode_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clip_channels(brands(spark, sf_dir), ("Brand5", "Brand6"))


@query("select distinct replace(p_brand, '#', '') as label, cast(regexp_extract(p_brand, '[0-9]+') as integer) as number from part where cast(regexp_extract(p_brand, '[0-9]+') as integer) in (4, 5, 6, 7)")
def neighbor_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clip_channels(brands(spark, sf_dir), ("Brand6", "Brand5"), "neighbors")


STIMS = [(0, "NATION", 3, 4), (1, "NATION", 10, 11), (2, "NATION", 0, 1), (3, "NATION", 23, 24), (4, "OTHER", 1, 2)]


@query(
    f"""with {NATION}, s(stim_id, e, x, y) as (values {", ".join(f"({i}, '{e}', {a}, {b})" for i, e, a, b in STIMS)}),
p as (select a.e, a.k, a.label as first, b.label as second from c a join c b on a.e = b.e and b.k = a.k + 1)
select stim_id, first, second, away, rank from (
  select stim_id, first, second, abs(k + 0.5 - (x + y) / 2.0)::double as away,
         row_number() over (partition by stim_id order by abs(k + 0.5 - (x + y) / 2.0), k) as rank
  from p join s using (e) where k not in (x, y) and k + 1 not in (x, y)) where rank <= 2"""
)
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stims = spark.createDataFrame(STIMS, "stim_id int, electrode string, a int, b int")
    return C.candidates(C.pairs(nations(spark, sf_dir)), stims, 2)


@query("select doc_id, coalesce(nullif(regexp_extract(source, '(rc[0-9]+)', 1), ''), source) as grp from documents")
def group_id_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", S.group_id(F.col("source"), "rc[0-9]+").alias("grp"))


@query(
    """with p as (select l_orderkey, l_linenumber, array_to_string(list_sort(['L' || l_partkey, 'L' || l_suppkey]), '-') as pair from lineitem)
select *, regexp_replace('S 1' || '_ev' || lpad(cast(l_linenumber as varchar), 2, '0') || '_' || pair, '[^\\w-]', '', 'g') as clip,
       regexp_replace('S1_ev' || lpad(cast(l_linenumber as varchar), 2, '0') || '_' || pair, '_ev[0-9]+.*$', '') as session from p"""
)
def pair_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = lambda c: F.concat(F.lit("L"), F.col(c).cast("string"))
    p = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.pair_string(label("l_partkey"), label("l_suppkey")).alias("pair"))
    return p.withColumns({"clip": S.clip_name(F.lit("S 1"), F.col("l_linenumber"), F.col("pair")), "session": S.session_of_clip(S.clip_name(F.lit("S1"), F.col("l_linenumber"), F.col("pair")))})


@query(
    """with a as (select p_partkey, case when p_partkey % 3 = 0 then 'Closed relay to P0' || p_size || ' and Q' || (p_size + 1) || ' ' || p_name else p_name end as note from part),
b as (select p_partkey, nullif(regexp_extract(note, 'Closed relay to ([A-Za-z]+[0-9]+) and ([A-Za-z]+[0-9]+)', 1), '') as x,
             nullif(regexp_extract(note, 'Closed relay to ([A-Za-z]+[0-9]+) and ([A-Za-z]+[0-9]+)', 2), '') as y from a)
select p_partkey, regexp_replace(x, '^([^0-9]*)0', '\\1') as chan_a, regexp_replace(y, '^([^0-9]*)0', '\\1') as chan_b from b where x is not null"""
)
def pattern_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    size = F.col("p_size")
    note = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Closed relay to P0"), size.cast("string"), F.lit(" and Q"), (size + 1).cast("string"), F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    a, b = S.relay_channels(F.col("note"))
    return p.select("p_partkey", note.alias("note")).select("p_partkey", a.alias("chan_a"), b.alias("chan_b")).where("chan_a is not null")


@query(
    """with b as (select distinct s_nationkey * 10.0 as base, 'N' || s_nationkey as chan from supplier)
select c_custkey as click_id, chan from (select c_custkey, chan, row_number() over (partition by c_custkey order by abs(c_acctbal / 30.0 - base), chan) as r from customer, b) where r = 1"""
)
def nearest_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "supplier").select((F.col("s_nationkey") * 10.0).alias("base"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("chan")).distinct()
    return C.nearest_channels(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("click_id"), (F.col("c_acctbal") / 30.0).alias("y")), base)


@query(
    f"""with {WIN}, j as (select a.chan, a.win, a.i, a.x - b.x as d from w a left join w b on b.chan = a.chan + 1 and b.i = a.i and b.win = a.win and a.chan % 2 = 0)
select chan, win, i, round(d - avg(d) over (partition by chan, win), 6) as bipolar from j"""
)
def bipolar_montage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windowed(spark, sf_dir)
    alt = w.select("chan").distinct().where("chan % 2 = 0").withColumn("partner", F.col("chan") + 1)
    return C.montage(w.select("chan", "win", "i", "x"), alt, ("win", "i")).select("chan", "win", "i", S.rounded("bipolar", 6).alias("bipolar"))


# Windows


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) as energy from embeddings")
def window_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", G.energy_of(F.col("embedding")).alias("energy")).withColumn("energy", S.rounded("energy", 6))


HOLES = "case when event_id % 7 = 0 or (chan % 11 = 0 and win = 2) then null else x end"


@query(f"with {WIN}, h as (select chan, win, i, {HOLES} as x from w) select chan, win, i, round(coalesce(x, m) - m, 6) as demeaned from (select *, coalesce(avg(x) over (partition by chan, win), 0.0) as m from h)")
def nan_fill_demean(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = windowed(spark, sf_dir).withColumn("x", F.expr(HOLES))
    return G.fill_demean(holed).select("chan", "win", "i", S.rounded("demeaned", 6).alias("demeaned"))


@query("select vec_id, round(list_sum(list_transform(range(2, len(embedding) + 1), lambda k: abs(embedding[k]::double - embedding[k - 1]::double))), 6) as ll from embeddings")
def line_length_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", G.line_length_of(F.transform("embedding", lambda x: x.cast("double"))).alias("ll")).withColumn("ll", S.rounded("ll", 6))


@query(f"with {LL} select clip, chan, win, round(ll, 6) as ll from l")
def line_length_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths(spark, sf_dir).select("clip", "chan", "win", S.rounded("ll", 6).alias("ll"))


@query(f"with {BASE} select clip, chan, n_baseline, round(med, 6) as med, round(mad, 6) as mad from med join mad using (clip, chan)")
def robust_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = G.robust_baseline(lengths(spark, sf_dir).where("win < 6"), keys=("clip",))
    return base.select("clip", "chan", "n_baseline", S.rounded("med", 6).alias("med"), S.rounded("mad", 6).alias("mad"))


@query(f"with {ZED} select clip, chan, win, round(z, 6) as z, valid from z")
def zscore_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return z_rows(spark, sf_dir).withColumn("z", S.rounded("z", 6))


@query("select vec_id, round(list_sum(list_transform(range(1, 65), lambda k: embedding[k]::double * pow(0.3, (64 - k)))), 9) as decayed from embeddings")
def decay_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each component as a window of one sample: what the buffer holds after the last."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.aggregate("embedding", F.lit(0.0), lambda b, x: 0.3 * b + x.cast("double")).alias("b"))
    return e.select("vec_id", S.rounded("b", 9).alias("decayed"))


@query(
    f"""with {WIN}, a as (select chan, win, x, i % 5 as j from w),
b as (select n.chan, n.win, n.j, sum(o.x * pow(0.3, n.win - o.win)) as b from a n join a o on o.chan = n.chan and o.j = n.j and o.win <= n.win group by 1, 2, 3)
select chan, win, round(sqrt(sum(b * b)), 6) as amplitude from b group by 1, 2"""
)
def decay_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windowed(spark, sf_dir).withColumn("place", F.col("i") % 5)
    return R.decaying_energy(w, ("chan",), "win", "place", "x").select("chan", "win", S.rounded(F.sqrt("energy"), 6).alias("amplitude"))


def vector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of embeddings as samples: ``vec_id``, ``i`` (from 0) and ``x``."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))


PLACES = "(select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as k from embeddings)"


@query(f"select vec_id, k::integer as k, round(embedding[k]::double - list_sum(list_transform(range(1, k + 1), lambda j: 0.01 * pow(0.99, k - j) * embedding[j]::double)), 9) as high from {PLACES}")
def leaky_highpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples of every window."""
    high = R.leaky_mean(vector_samples(spark, sf_dir), 0.99, ("vec_id",), "i", "x")
    return high.select("vec_id", (F.col("i") + 1).alias("k"), S.rounded("high", 9).alias("high"))


@query(f"with {EV} select a.event_id, round(any_value(a.x) - sum(0.01 * pow(0.99, a.i - b.i) * b.x), 6) as high from ev a join ev b on a.chan = b.chan and b.i <= a.i group by 1")
def leaky_highpass_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole channels, whose filter state goes from block to block."""
    high = R.leaky_mean(samples(spark, sf_dir), 0.99, ("chan",), "i", "x", block=16)
    return high.select("event_id", S.rounded("high", 6).alias("high"))


#: Band-pass and notch of the clip detector, for samples taken 200 times a second; and what they answer to a single 1.
RATE = 200.0
BAND_PASS, NOTCH = butter_band(4, 1, 50, RATE), butter_band(2, 58, 62, RATE, stop=True)
BOTH = np.concatenate([BAND_PASS, NOTCH])


def response(sections: np.ndarray, n: int) -> str:
    return "[" + ", ".join(repr(float(y)) for y in run_sections(sections, np.eye(n, 1)[:, 0:1])[:, 0]) + "]"


def convolved(sections: np.ndarray) -> str:
    return f"with h as (select {response(sections, 64)}::double[] as h) select vec_id, k::integer as k, round(list_sum(list_transform(range(1, k + 1), lambda j: h[k - j + 1] * embedding[j]::double)), 6) as y from {PLACES}, h"


def filtered_vectors(spark: SparkSession, sf_dir: str, sections: np.ndarray) -> DataFrame:
    y = R.filtered(vector_samples(spark, sf_dir), sections, ("vec_id",), "i", "x")
    return y.select("vec_id", (F.col("i") + 1).alias("k"), S.rounded("filtered", 6).alias("y"))


@query(convolved(BAND_PASS))
def bandpass_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band-pass of every vector as a window of samples."""
    return filtered_vectors(spark, sf_dir, BAND_PASS)


@query(convolved(NOTCH))
def notch_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notch of every vector as a window of samples."""
    return filtered_vectors(spark, sf_dir, NOTCH)


@query(f"with {EV}, h as (select {response(BOTH, 256)}::double[] as h) select a.event_id, round(sum(h[a.i - b.i + 1] * b.x), 3) as y from ev a join ev b on a.chan = b.chan and b.i <= a.i, h group by 1")
def filtered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band-pass and notch of whole channels in one scan, whose state goes from block to block."""
    return R.filtered(samples(spark, sf_dir), BOTH, ("chan",), "i", "x", block=16).select("event_id", S.rounded("filtered", 3).alias("y"))


#: Vectors as windows of half a second: bins are 2 Hz wide.
SECOND = 128.0
SPECTRUM = {"inband": (1, 30), "hf": (40, 62), "line": (49, 51)}


def power_sql(low: float, high: float) -> str:
    """Sum over the bins of a band of the squared Fourier sums, by the definition."""
    part = lambda f: f"pow(list_sum(list_transform(range(0, 64), lambda n: wx[n + 1] * {f}(2 * pi() * k * n / 64))), 2)"
    return f"list_sum(list_transform(range({math.ceil(low / 2)}, {math.floor(high / 2)} + 1), lambda k: case when k in (0, 32) then 1 else 2 end * ({part('cos')} + {part('sin')}))) / (64 * ww)"


SPECTRA = f"""v as (select vec_id, label, list_transform(range(0, 64), lambda n: embedding[n + 1]::double * (0.54 - 0.46 * cos(2 * pi() * n / 63))) as wx,
  list_sum(list_transform(range(0, 64), lambda n: pow(0.54 - 0.46 * cos(2 * pi() * n / 63), 2))) as ww from embeddings),
b as (select vec_id, label, {", ".join(f"{power_sql(*f)} as {name}" for name, f in SPECTRUM.items())} from v)"""


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", *(G.band_energy_of(F.col("embedding"), SECOND, *f).alias(name) for name, f in SPECTRUM.items()))


@query(f"with {SPECTRA} select vec_id, round(inband, 9) as inband, round(hf, 9) as hf, round(line, 9) as line from b")
def band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir).select("vec_id", *(S.rounded(c, 9).alias(c) for c in SPECTRUM))


@query(
    f"""with {SPECTRA}, m as (select label, median(hf) as med from b group by 1), d as (select b.label, median(abs(hf - med)) as mad from b join m using (label) group by 1),
z as (select vec_id, hf / (inband + {S.EPS}) as share, (hf - med) / (1.4826 * mad + {S.EPS}) as z, line / (inband + {S.EPS}) > 0.1 as line_bad from b join m using (label) join d using (label))
select vec_id, share >= 0.2 and (z >= 2 or share > 0.6) as hf_bad, line_bad from z"""
)
def spectral_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both vetoes of the clip detector on band powers; a label is a channel."""
    b = spectra(spark, sf_dir)
    m = b.groupBy("label").agg(F.median("hf").alias("med"))
    d = b.join(m, "label").groupBy("label").agg(F.median(F.abs(F.col("hf") - F.col("med"))).alias("mad"))
    z = b.join(m, "label").join(d, "label").withColumn("z", (F.col("hf") - F.col("med")) / (1.4826 * F.col("mad") + S.EPS))
    return z.select("vec_id", G.hf_veto(F.col("hf"), F.col("inband"), F.col("z"), 0.2, 2.0, 0.6).alias("hf_bad"), G.line_noise_veto(F.col("line"), F.col("inband"), 0.1).alias("line_bad"))


@query(
    f"""with recursive {EV}, w as (select chan, i // 2 as win, count(*) filter (where x > 80) as over from ev group by 1, 2),
r as (select chan, win, over as counter from w where win = 0
  union all select w.chan, w.win, greatest(0, r.counter - case when (w.win + 1) % 6 = 0 then 2 else 0 end) + w.over from r join w on w.chan = r.chan and w.win = r.win + 1)
select chan, win, counter::bigint as counter from r"""
)
def bad_channel_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loud samples of each channel, counted by windows of two; every sixth window takes two back."""
    w = samples(spark, sf_dir).groupBy("chan", F.floor(F.col("i") / 2).alias("win")).agg(F.count_if(F.col("x") > 80).alias("over"))
    return R.bad_counter(w, "over", ("chan",), "win", every=6, less=2, block=8).select("chan", "win", F.col("counter").cast("long").alias("counter"))


BANDS = "b as (select vec_id, label, list_sum(list_transform(embedding[49:64], lambda x: x::double * x::double)) as hf, list_sum(list_transform(embedding[1:32], lambda x: x::double * x::double)) as inband from embeddings)"


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", G.energy_of(F.slice("embedding", 49, 16)).alias("hf"), G.energy_of(F.slice("embedding", 1, 32)).alias("inband"))


@query(
    f"""with {BANDS}, m as (select label, median(hf) as med from b group by 1), d as (select b.label, median(abs(hf - med)) as mad from b join m using (label) group by 1),
z as (select vec_id, hf / (inband + {S.EPS}) as share, (hf - med) / (1.4826 * mad + {S.EPS}) as z from b join m using (label) join d using (label))
select vec_id, share >= 0.2 and (z >= 2 or share > 0.6) as hf_bad from z"""
)
def artifact_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bands(spark, sf_dir)
    m = b.groupBy("label").agg(F.median("hf").alias("med"))
    d = b.join(m, "label").groupBy("label").agg(F.median(F.abs(F.col("hf") - F.col("med"))).alias("mad"))
    z = (F.col("hf") - F.col("med")) / (1.4826 * F.col("mad") + S.EPS)
    return b.join(m, "label").join(d, "label").select("vec_id", G.hf_veto(F.col("hf"), F.col("inband"), z, z=2.0, ratio=0.6).alias("hf_bad"))


@query(f"with {BANDS} select label, sum(hf) / (sum(inband) + {S.EPS}) > 0.5 as line_bad from b group by label")
def line_noise_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands(spark, sf_dir).groupBy("label").agg(G.line_noise_veto(F.sum("hf"), F.sum("inband")).alias("line_bad"))


@query(f"with {EV}, s as (select chan, t as on_ from ev where event_type = 'error'), n as (select event_id, t, (select min(on_) from s where s.chan = ev.chan and on_ > ev.t + 1e-6) as nx from ev) select event_id, coalesce(t >= nx - 7200, false) as cap_bad from n")
def next_event_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = samples(spark, sf_dir)
    onset = F.min(F.when(F.col("event_type") == "error", F.col("t"))).over(Window.partitionBy("chan").orderBy(F.desc("t"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1))
    return e.select("event_id", G.next_stim_veto(F.col("t"), onset, 7200).alias("cap_bad"))


@query(f"with {EV}, o as (select *, x > 30 and coalesce(lead(x) over (partition by chan order by i) > 30, false) as twice from ev) select event_id, coalesce(i >= min(case when twice then i end) over (partition by chan), false) as cut from o")
def sat_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.saturation_cut(samples(spark, sf_dir), F.col("x") > 30, ("chan",), "i").select("event_id", "cut")


# Patterns


@query(f"with {RUN} select clip, round(score, 6) as score, chan, onset_win from s")
def n_run_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run_score(z_rows(spark, sf_dir), 3).withColumn("score", S.rounded("score", 6))


@query(f"with {RUN} select clip, round(score, 6) as score, score > 1.0 as detected, case when score > 1.0 then chan end as chan, case when score > 1.0 then onset_win end as onset_win from s")
def clip_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.detect(P.run_score(z_rows(spark, sf_dir), 3), 1.0).withColumn("score", S.rounded("score", 6))


STUDY = WIN + """, l as (
  select chan % 10 as clip, chan, win, sum(step) as ll, max(x) * max(x) as hf, sum(x * x) as inband, sum(case when event_type = 'error' then x * x else 0 end) as line
  from (select *, coalesce(abs(x - lag(x) over (partition by chan, win order by i)), 0) as step from w) group by 1, 2, 3),
b as (select *, row_number() over (partition by chan order by ll) as r, count(*) over (partition by chan) as n from l where win < 6 and clip <> 7),
m1 as (select chan, median(ll) as med from b where r <= greatest(1, floor(n * 0.8 + 1e-9)) group by 1),
m2 as (select b.chan, median(abs(ll - med)) as mad from b join m1 using (chan) where r <= greatest(1, floor(n * 0.8 + 1e-9)) group by 1),
h1 as (select chan, median(hf) as hmed from b group by 1), h2 as (select chan, median(abs(hf - hmed)) as hmad from b join h1 using (chan) group by 1),
c as (select clip, chan, sum(line) as line, sum(inband) as whole from l group by 1, 2),
e as (select c.*, coalesce(med, 0) as med, coalesce(mad, 0) as mad, coalesce(hmed, 0) as hmed, coalesce(hmad, 0) as hmad, hmed is not null as based from c left join m1 using (chan) left join m2 using (chan) left join h1 using (chan) left join h2 using (chan)),
g as (select clip, median(med) as gmed from e group by 1),
z as (select l.clip, l.chan, l.win - 6 as win, (l.ll - med) / (greatest(1.4826 * mad, 0.25 * gmed) + {eps}) as z,
  l.hf / (l.inband + {eps}) >= 0.3 and ((based and (l.hf - hmed) / (1.4826 * hmad + {eps}) >= 3) or l.hf / (l.inband + {eps}) > 0.8) as hf_bad,
  e.line / (e.whole + {eps}) > 0.4 as line_bad, l.clip % 3 = 0 and l.win - 6 >= 8 + l.clip - 0.5 as cap_bad
  from l join e using (clip, chan) join g on g.clip = l.clip where l.win >= 6 and l.clip <> 8)""".replace("{eps}", str(S.EPS))
STUDIED = clips_of.ClipParams(n=2, hf_spare=0.3, hf_z=3.0, hf_ratio=0.8, line_ratio=0.4, threshold=1.0)


def studied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as features of 12 clips: the first six windows of a channel come before the
    stimulation. Clip 7 has none before it, clip 8 none after it, clips 10 and 11 no channel."""
    w = windowed(spark, sf_dir)
    each = G.line_length(w).join(w.groupBy("chan", "win").agg(F.max("x").alias("hf"), F.sum(F.col("x") * F.col("x")).alias("inband"), F.sum(F.when(F.col("event_type") == "error", F.col("x") * F.col("x")).otherwise(0.0)).alias("line")), ["chan", "win"])
    each = each.withColumns({"clip": (F.col("chan") % 10).cast("string"), "hf": F.col("hf") * F.col("hf"), "k": (F.col("win") - 6).cast("int")})
    before = F.when((F.col("k") < 0) & (F.col("clip") != "7"), F.struct("ll", "hf"))
    after = F.when((F.col("k") >= 0) & (F.col("clip") != "8"), F.struct(F.col("k").alias("win"), F.col("k").cast("double").alias("t"), "ll", "hf", "inband"))
    found = each.groupBy("clip", F.col("chan").cast("int").alias("chan")).agg(F.collect_list(before).alias("base"), F.collect_list(after).alias("post"), F.sum("line").alias("line"), F.sum("inband").alias("whole"))
    id_ = F.col("id")
    listed = spark.range(12).select(id_.cast("string").alias("clip"), F.lit(0.0).alias("stim_off"), F.when((id_ < 10) & (id_ % 3 == 0), 8.0 + id_).alias("next_stim_on"), F.array().cast("array<string>").alias("candidates"))
    return found, listed


@query(f"with {STUDY} select clip, chan::integer as chan, win::integer as win, case when abs(z) < 1e9 then round(z, 6) end as z, hf_bad, line_bad, cap_bad, not (hf_bad or line_bad or cap_bad) as valid from z")
def clip_study_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything of the clip detector behind its filters: baselines, scores of windows, vetoes."""
    w = clips_of.windows(*studied(spark, sf_dir), STUDIED)
    return w.select(F.col("clip").cast("long").alias("clip"), "chan", "win", F.when(F.abs("z") < 1e9, S.rounded("z", 6)).alias("z"), "hf_bad", "line_bad", "cap_bad", "valid")


@query(
    f"""with {STUDY}, v as (select *, not (hf_bad or line_bad or cap_bad) as valid from z),
r as (select clip, chan, win, case when n = 2 then low else -'inf'::double end as run_min from (
  select clip, chan, win, min(case when valid then z else -'inf'::double end) over f as low, count(*) over f as n from v window f as (partition by clip, chan order by win rows between current row and 1 following))),
s as (select clip, run_min as score, win from (select *, row_number() over (partition by clip order by run_min desc, chan, win) as o from r) where o = 1)
select k as clip, case when score > 1e9 then null when score is null then -'inf'::double else round(score, 6) end as score, coalesce(score > 1.0, false) as detected, case when score > -'inf'::double then win::double end as onset
from range(12) as u(k) left join s on s.clip = k"""
)
def clip_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all clips, those without any window too."""
    found, listed = studied(spark, sf_dir)
    s = clips_of.scores(clips_of.windows(found, listed, STUDIED), listed, STUDIED)
    return s.select(F.col("clip").cast("long").alias("clip"), F.when(F.col("score") <= 1e9, S.rounded("score", 6)).alias("score"), "detected", "onset")


#: The whole clip detector on events as samples of 200 Hz: windows of 5 samples, six before the stimulation, 3 s of it, then all others.
DETECTED = clips_of.ClipParams(window=0.025, n=2, hf_band=(70.0, 95.0), hf_spare=0.3, hf_z=3.0, hf_ratio=0.8, line_ratio=0.2, threshold=1.0, margin=0.012)
DETECT = f"h as (select {response(BOTH, 256)}::double[] as h), " + EV + """, y as (
  select a.chan, a.i, any_value(a.x) as x, sum(h[a.i - b.i + 1] * b.x) as y from ev a join ev b on a.chan = b.chan and b.i <= a.i, h group by 1, 2),
n as (select chan, count(*) as n from ev group by 1),
w as (select y.*, n, case when i < 30 then i // 5 else (i - 33) // 5 + 6 end as win, case when i < 30 then i % 5 else (i - 33) % 5 end as j from y join n using (chan)
  where i < 30 or (i >= 33 and 33 + ((i - 33) // 5 + 1) * 5 <= n)),
wh as (select sum(pow(0.54 - 0.46 * cos(2 * pi() * j / 4), 2)) * 5 as ww from range(5) as u(j)),
f as (select chan, win, k, 2 * (pow(sum(x * (0.54 - 0.46 * cos(2 * pi() * j / 4)) * cos(2 * pi() * k * j / 5)), 2) + pow(sum(x * (0.54 - 0.46 * cos(2 * pi() * j / 4)) * sin(2 * pi() * k * j / 5)), 2)) as e
  from w, range(1, 3) as v(k) group by 1, 2, 3),
l as (select chan % 10 as clip, chan, win, ll, hf, inband from (select chan, win, sum(step) as ll from (select *, coalesce(abs(y - lag(y) over (partition by chan, win order by i)), 0) as step from w) group by 1, 2)
  join (select chan, win, max(case when k = 2 then e end) / any_value(ww) as hf, max(case when k = 1 then e end) / any_value(ww) as inband from f, wh group by 1, 2) using (chan, win)),
cn as (select chan, n, sum(pow(0.54 - 0.46 * cos(2 * pi() * i / (n - 1)), 2)) * n as ww from ev join n using (chan) group by 1, 2),
cf as (select ev.chan, k, n, case when 2 * k = n then 1 else 2 end * (pow(sum(x * (0.54 - 0.46 * cos(2 * pi() * i / (n - 1))) * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * (0.54 - 0.46 * cos(2 * pi() * i / (n - 1))) * sin(2 * pi() * k * i / n)), 2)) / any_value(ww) as e
  from ev join cn using (chan), range(1, 51) as v(k) where k <= n / 2 and k * 200.0 / n <= 61 group by 1, 2, 3),
c as (select chan % 10 as clip, chan, coalesce(sum(e) filter (where k * 200.0 / n between 59 and 61), 0) as line, coalesce(sum(e) filter (where k * 200.0 / n between 1 and 50), 0) as whole from cf group by 1, 2),
""" + STUDY[STUDY.index("b as (select *, row_number()") : STUDY.index("c as (select clip, chan, sum(line)")].replace(" and clip <> 7", "") + STUDY[STUDY.index("e as (select c.*") :].replace(">= 0.3 and", ">= 0.3 and").replace("e.line / (e.whole", "e.line / (e.whole").replace("> 0.4 as line_bad", "> 0.2 as line_bad").replace("l.clip % 3 = 0 and l.win - 6 >= 8 + l.clip - 0.5 as cap_bad", "l.clip % 3 = 0 and 0.165 + (l.win - 6) * 0.025 >= 0.3 + l.clip / 100.0 - 0.012 as cap_bad").replace(" and l.clip <> 8", "")


def detected_clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Windows of the clips, judged; and the clips."""
    rows = samples(spark, sf_dir).select((F.col("chan") % 10).cast("string").alias("clip"), "chan", "i", "x")
    id_ = F.col("id")
    listed = spark.range(10).select(id_.cast("string").alias("clip"), F.lit(0.15).alias("stim_on"), F.lit(0.165).alias("stim_off"), F.when(id_ % 3 == 0, 0.3 + id_ / 100).alias("next_stim_on"), F.array().cast("array<string>").alias("candidates"))
    found = clips_of.sample_features(rows, listed, RATE, DETECTED)
    return clips_of.windows(found, listed, DETECTED), listed


@query(f"with {DETECT} select clip, chan::integer as chan, win::integer as win, case when abs(z) < 1e6 then round(z, 4) end as z, hf_bad, line_bad, cap_bad from z")
def clip_detector_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clip detector from samples on: filters, line lengths, band powers, baselines, scores and vetoes of all windows."""
    w, _ = detected_clips(spark, sf_dir)
    return w.select(F.col("clip").cast("long").alias("clip"), "chan", "win", F.when(F.abs("z") < 1e6, S.rounded("z", 4)).alias("z"), "hf_bad", "line_bad", "cap_bad")


#: The same with a clip for each channel, which gives as many clips as there are users; and what is known of them.
ONE_CHANNEL = DETECT.replace("chan % 10 as clip", "chan as clip").replace("l.clip / 100.0", "l.clip % 10 / 100.0") + """,
v as (select *, not (hf_bad or line_bad or cap_bad) as valid from z),
r as (select clip, win, case when n = 2 then low else -'inf'::double end as run_min from (
  select clip, win, min(case when valid then z else -'inf'::double end) over f as low, count(*) over f as n from v window f as (partition by clip order by win rows between current row and 1 following))),
b as materialized (select clip, run_min as score, win from r qualify row_number() over (partition by clip order by run_min desc, win) = 1),
sc as (select chan as clip, n, coalesce(score, -'inf'::double) as score, case when score > -'inf'::double then 0.165::double + 0.025::double * win end as onset from n left join b on b.clip = n.chan)""".replace("b as materialized", "best as").replace("left join b on b.clip", "left join best on best.clip")
ANNOTATED = ONE_CHANNEL + """, an as (select clip, n, score, onset, clip % 3 = 0 as truth, 0.215 as ad_onset, 0.215 + clip % 7 as ad_offset, clip % 11 = 0 as ongoing from sc where clip % 3 < 2)"""


def channel_clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scores of clips of one channel; and the clips."""
    s = samples(spark, sf_dir)
    rows = s.select(F.col("chan").cast("string").alias("clip"), F.lit(0).alias("chan"), "i", "x")
    listed = s.groupBy("chan").agg(F.count("*").alias("n")).select(F.col("chan").cast("string").alias("clip"), F.lit(0.15).alias("stim_on"), F.lit(0.165).alias("stim_off"), F.when(F.col("chan") % 3 == 0, 0.3 + F.col("chan") % 10 / 100).alias("next_stim_on"), F.array().cast("array<string>").alias("candidates"), (F.col("n") / RATE).alias("clip_end"))
    judged = clips_of.windows(clips_of.sample_features(rows, listed, RATE, DETECTED), listed, DETECTED)
    return clips_of.scores(judged, listed, DETECTED), listed


@query(f"with {ONE_CHANNEL} select clip, case when abs(score) < 1e6 or score = -'inf'::double then round(score, 4) end as score, score > 1.0 as detected, round(onset, 6) as onset from sc")
def clip_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clip detector from samples to scores, a clip for each channel."""
    s, _ = channel_clips(spark, sf_dir)
    return s.select(F.col("clip").cast("long").alias("clip"), F.when((F.abs("score") < 1e6) | (F.col("score") == P.LOWEST), S.rounded("score", 4)).alias("score"), "detected", S.rounded("onset", 6).alias("onset"))


def annotated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What validation needs of annotated clips."""
    scored, listed = channel_clips(spark, sf_dir)
    k = F.col("clip").cast("long")
    told = F.when(k % 3 == 0, "y").when(k % 3 == 1, "n").otherwise("u")
    marks = listed.select(F.col("clip").alias("clip_name"), F.concat(F.lit("HUP"), (k % 8).cast("string"), F.lit("_phaseII")).alias("ieeg_name"), told.alias("AD"), F.lit(0.215).alias("AD_onset"), (F.lit(0.215) + k % 7).alias("AD_offset"), (k % 11 == 0).cast("double").alias("ad_ongoing"))
    placed = listed.select("clip", F.lit(0.0).alias("clip_start"), "clip_end", F.col("stim_on").alias("on"), F.col("stim_off").alias("off"))
    return clips_of.build_features(scored, placed, marks, DETECTED)


@query(
    f"""with {ANNOTATED} select clip, 'HUP' || (clip % 8) as patient, truth, not (truth and not ongoing and ad_offset - ad_onset < 3) as evaluable, case when abs(score) < 1e6 or score = -'inf'::double then round(score, 4) end as score, round(onset, 6) as onset,
  round((n / 200.0::double - 0.165::double) / 60, 9) as minutes from an"""
)
def ad_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated clips with their scores, as validation takes them."""
    f = annotated_features(spark, sf_dir)
    score = F.when((F.abs("score") < 1e6) | (F.col("score") == P.LOWEST), S.rounded("score", 4))
    return f.select(F.col("clip").cast("long").alias("clip"), "patient", "truth", "evaluable", score.alias("score"), S.rounded("onset", 6).alias("onset"), S.rounded("minutes", 9).alias("minutes"))


@query()
def clip_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole study: clips from their samples to pooled rates, each patient judged by the thresholds of the others."""
    return clips_of.validate(annotated_features(spark, sf_dir), DETECTED)


ABOVE = ZED + """, a as (select clip, chan, win, win - row_number() over (partition by clip, chan order by win) as island from z where valid and z > 0.8),
u as (select clip, chan, min(win) as start, max(win) as stop, count(*) as length from a group by clip, chan, island)"""


def above_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.runs(z_rows(spark, sf_dir), F.col("valid") & (F.col("z") > 0.8), ("clip", "chan"), "win")


@query(f"with {ABOVE} select * from u")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return above_runs(spark, sf_dir)


@query(f"with {ABOVE} select * from u where length < 3")
def near_miss_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.near_misses(above_runs(spark, sf_dir), 3)


@query(
    f"""with {ABOVE}, m as (
  select clip, chan, win, case when n = 3 then low else -'inf'::double end as run_min from (
    select clip, chan, win, min(case when valid then z else -'inf'::double end) over f as low, count(*) over f as n
    from z window f as (partition by clip, chan order by win rows between current row and 2 following))),
s as (select clip, chan, win from (select *, row_number() over (partition by clip order by run_min desc, chan, win) as r from m) where r = 1 and run_min > 0.8)
select u.clip, u.chan, u.start, u.stop from u join s using (clip, chan) where s.win between u.start and u.stop"""
)
def detected_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.detect(P.run_score(z_rows(spark, sf_dir), 3), 0.8)
    return P.detected_span(above_runs(spark, sf_dir), found)


@query(f"with {ZED} select clip, chan, round(max(case when valid then z end), 6) as max_z, count(*) as windows, count(*) filter (where not valid) as vetoed, count(*) filter (where valid and z > 0.8) as above from z group by 1, 2")
def diagnose_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = z_rows(spark, sf_dir)
    count = lambda c: F.sum(c.cast("long"))
    return z.groupBy("clip", "chan").agg(S.rounded(F.max(F.when(F.col("valid"), F.col("z"))), 6).alias("max_z"), F.count("*").alias("windows"), count(~F.col("valid")).alias("vetoed"), count(F.col("valid") & (F.col("z") > 0.8)).alias("above"))


@query(f"with {EV} select event_id, coalesce(sum(case when x > 20 then 1 else 0 end) over f, 0)::bigint as votes, sum(case when x > 20 then 1 else 0 end) over f > 7.5 as voted from ev window f as (partition by chan order by i rows between 14 preceding and current row)")
def vote_k_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.votes(samples(spark, sf_dir), F.col("x") > 20, 15, 7.5, ("chan",), "i").select("event_id", "votes", "voted")


@query(f"with {EV}, c as (select event_id, x, t, max(case when x > 60 then t end) over (partition by chan order by i rows between unbounded preceding and current row) as last from ev) select event_id, x > 15 and not coalesce(t - last < 36000, false) as cooled from c")
def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cool_down(samples(spark, sf_dir), F.col("x") > 15, F.col("x") > 60, 36000.0, ("chan",), "t").select("event_id", "cooled")


@query(f"with {EV} select chan, event_type, event_id from (select *, row_number() over (partition by chan, event_type order by t, event_id) as r from ev) where r = 1")
def first_per_stim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_per(samples(spark, sf_dir), ("chan", "event_type"), ("t", "event_id")).select("chan", "event_type", "event_id")


@query(
    f"""with {EV}, r as (select event_id, x, coalesce(sum(x) over (partition by chan order by i rows between 100 preceding and 51 preceding), 0.0) / 50 as b from ev)
select event_id, round(case when b = 0 and x > 0 then 'inf'::double when b = 0 then null else x / b end, 6) as ratio from r"""
)
def rolling_baseline_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event over the mean of the oldest 50 of the 100 before it, as the detector keeps them."""
    return P.baseline_ratio(samples(spark, sf_dir), "x", ("chan",), "i").select("event_id", S.rounded("ratio", 6).alias("ratio"))


@query(
    f"""with {EV}, g as (select *, case when x > 40 then true when x < 10 then false end as edge from ev)
select event_id, coalesce(last_value(edge ignore nulls) over (partition by chan order by i rows between unbounded preceding and current row), false) as on_state from g"""
)
def schmitt_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.schmitt(samples(spark, sf_dir), "x", 40, 10, ("chan",), "i").select("event_id", F.col("on").alias("on_state"))


#: The detector on events as windows: seconds are hours and days, and thresholds suit values of about 50.
RULE = D.Rule(on=40.0, off=12.0, vote_rows=5, vote_least=3, separation_seconds=6 * HOUR, baseline_rows=10, baseline_kept=5, look_seconds=5 * 24 * HOUR, ratio=1.2345, saturation=6.0, cool_seconds=2 * HOUR, history_rows=8, history_least=2)
#: The same as a state machine that takes one row after the other.
MACHINE = f"""recursive {EV}, r as (
  select chan, -1::bigint as i, 0.0::double as t, false as is_on, []::boolean[] as v, null::double as last_on, null::double as last_off, 0 as stim, list_transform(range({RULE.baseline_rows}), lambda k: 0.0::double) as quiet,
    null::double as base, null::double as sat, []::boolean[] as hist, false as told, false as begins, false as ends, false as ad from (select distinct chan from ev)
  union all
  select chan, i, t, begins or (is_on and not ends), case when begins then [] else v end, case when begins then t else last_on end, case when ends then t else last_off end, stim, case when is_on then quiet else list_append(quiet[2:], x) end,
    base, sat, hist, told or ad, begins, ends, ad from (
   select *, look and len(list_filter(hist, lambda b: b)) >= {RULE.history_least} and not told as ad from (
    select * exclude (hist, stim, told), stim + begins::int as stim, told and not begins as told,
      case when look then list_append(hist, ratio > {RULE.ratio} and ratio < {RULE.saturation} and not coalesce(t - sat < {RULE.cool_seconds}, false))[-{RULE.history_rows}:] else [] end as hist from (
     select * exclude (sat), case when ratio > {RULE.saturation} then t else sat end as sat from (
      select *, case when is_on or look then case when base = 0 and x > 0 then 'inf'::double when base = 0 then null else x / base end end as ratio from (
       select * exclude (base), case when begins then list_sum(quiet[1:{RULE.baseline_kept}]) / {RULE.baseline_kept} else base end as base from (
        select *, not is_on and len(list_filter(v, lambda b: b)) >= {RULE.vote_least} and (last_on is null or t > last_on + {RULE.separation_seconds}) as begins, is_on and x < {RULE.off} as ends from (
         select ev.chan, ev.i, ev.t, ev.x, r.is_on, r.last_on, r.last_off, r.stim, r.quiet, r.base, r.sat, r.hist, r.told,
           case when r.is_on then r.v else list_append(r.v, ev.x > {RULE.on})[-{RULE.vote_rows}:] end as v,
           not r.is_on and r.last_off is not null and not ev.t > r.last_off + {RULE.look_seconds} as look
         from r join ev on ev.chan = r.chan and ev.i = r.i + 1))))))))"""


def powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("chan", "i", "t", F.col("x").alias("power"))


@query(f"with {MACHINE} select chan, i as on_i, end_i as off_i, round(t, 3) as on_t, round(end_t, 3) as off_t from (select *, lead(i) over w as end_i, lead(t) over w as end_t from r where begins or ends window w as (partition by chan order by i)) where begins")
def stim_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stimulations of every channel: votes, hysteresis and a least separation."""
    found = D.stimulations(powers(spark, sf_dir), RULE)
    return found.select("chan", "on_i", "off_i", S.rounded("on", 3).alias("on_t"), S.rounded("off", 3).alias("off_t"))


EVENT_LOG_SQL = f"with {MACHINE} select chan, kind, i, round(t, 3) as t, stim from (select *, unnest([case when begins then 'stim_on' end, case when ends then 'stim_off' end, case when ad then 'ad' end]) as kind from r) where kind is not null"


@query(EVENT_LOG_SQL)
def rt_detector_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector's log: stimulations, and the first window of each that looks like a discharge."""
    return D.event_log(powers(spark, sf_dir), RULE).select("chan", "kind", "i", S.rounded("t", 3).alias("t"), "stim")


@query(f"with {MACHINE} select chan, i, is_on, stim, round(base, 6) as baseline, len(list_filter(hist, lambda b: b)) as votes from r where i >= 0")
def detector_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State behind every window: whether the channel is on, its frozen baseline, its votes since the latest reset."""
    rows = powers(spark, sf_dir)
    found = written(D.stimulations(rows, RULE), "stimulations")
    states = D.detector_rows(rows, found, RULE)
    later = F.coalesce(F.lead("is_on").over(Window.partitionBy("chan").orderBy("i")), F.lit(None))
    last = states.withColumn("later", later).join(found.select("chan", F.col("on_i").alias("i"), F.lit(True).alias("begins")), ["chan", "i"], "left").join(found.select("chan", F.col("off_i").alias("i"), F.lit(True).alias("ends")), ["chan", "i"], "left")
    is_on = F.coalesce("later", S.true_if(F.col("begins")) | (F.col("is_on") & ~S.true_if(F.col("ends"))))
    return last.select("chan", "i", is_on.alias("is_on"), "stim", S.rounded("baseline", 6).alias("baseline"), F.col("votes").cast("long").alias("votes"))


#: Stimulations of each stretch of five days on its own, as a state machine.
CHUNK = 5 * 24 * HOUR
CHUNKED = f"""recursive {EV}, ck as (select chan, t, x, floor(t / {CHUNK}) as chunk, row_number() over (partition by chan, floor(t / {CHUNK}) order by i) - 1 as i, max(t) over (partition by chan, floor(t / {CHUNK})) as ends_at from ev),
s as (select distinct chan, chunk, -1::bigint as i, 0.0::double as t, 0.0::double as ends_at, false as is_on, []::boolean[] as v, null::double as last_on, false as begins, false as ends from ck
  union all
  select chan, chunk, i, t, ends_at, begins or (is_on and not ends), case when begins then [] else v end, case when begins then t else last_on end, begins, ends from (
   select *, not is_on and len(list_filter(v, lambda b: b)) >= {RULE.vote_least} and (last_on is null or t > last_on + {RULE.separation_seconds}) as begins, is_on and x < {RULE.off} as ends from (
    select ck.chan, ck.chunk, ck.i, ck.t, ck.x, ck.ends_at, s.is_on, s.last_on, case when s.is_on then s.v else list_append(s.v, ck.x > {RULE.on})[-{RULE.vote_rows}:] end as v
    from s join ck on ck.chan = s.chan and ck.chunk = s.chunk and ck.i = s.i + 1))),
st as (select chan, t as on_t, coalesce(case when lead(ends) over w then lead(t) over w end, ends_at) as off_t, begins from s where begins or ends window w as (partition by chan, chunk order by i))"""


@query(f"with {CHUNKED} select chan, event::integer as event, round(on_t, 3) as on_t, round(off_t, 3) as off_t, round(off_t - on_t, 3) as dur_s from (select *, row_number() over (partition by chan order by on_t) as event from st where begins) where event <= 2")
def first_stims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two stimulations of each channel with their durations, from a search that ends early."""
    found = D.first_stimulations(powers(spark, sf_dir), RULE, 2, CHUNK)
    return found.select("chan", "event", S.rounded("on", 3).alias("on_t"), S.rounded("off", 3).alias("off_t"), S.rounded("dur_s", 3).alias("dur_s"))


@query(f"with {EV} select chan % 10 as session, chan, i, round(x, 6) as x from ev where i between 3 * (chan % 10) and 3 * (chan % 10) + 20 and chan % 10 <> 4")
def segment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored as segments, and a range of each session but one read back."""
    path = new_path(spark, "segments")
    rows = samples(spark, sf_dir).select((F.col("chan") % 10).alias("session"), "chan", F.col("i").cast("long").alias("i"), "x")
    X.write_segments(X.segments(rows, 8), path, 16)
    id_ = F.col("id")
    ranges = spark.range(10).where("id <> 4").select(id_.alias("range"), id_.cast("int").alias("session"), (3 * id_).alias("first"), (3 * id_ + 20).alias("last"))
    found = X.read_ranges(spark, path, ranges, 16).select(F.col("session").cast("long").alias("session"), "chan", "first_sample", F.posexplode("samples").alias("k", "x"))
    return found.select("session", "chan", (F.col("first_sample") + F.col("k")).alias("i"), S.rounded("x", 6).alias("x"))


# Events


STIM = EV + ", q as (select chan, event_id as event, event_type as kind, t as on_, t + x * 600 as off_ from ev)"


def stims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("chan", F.col("event_id").alias("event"), F.col("event_type").alias("kind"), F.col("t").alias("on"), (F.col("t") + F.col("x") * 600).alias("off"))


@query(
    f"""with {STIM}, a as (select *, coalesce(kind <> lag(kind) over (partition by chan order by on_, event), true) as change from q),
b as (select *, sum(change::int) over (partition by chan order by on_, event rows unbounded preceding) as run from a),
c as (select *, coalesce(on_ - max(off_) over (partition by chan, run order by on_, event rows between unbounded preceding and 1 preceding) >= 7200, false) as fresh from b),
d as (select *, sum(fresh::int) over (partition by chan, run order by on_, event rows unbounded preceding) as island from c)
select chan, kind, cast(round(min(on_) * 1e6) as bigint) as on_us, cast(round(max(off_) * 1e6) as bigint) as off_us, count(*) as merged from d group by chan, run, island, kind"""
)
def merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.merge_events(stims(spark, sf_dir), 7200.0, ("chan",), "kind")
    return m.select("chan", "kind", F.round(F.col("on") * 1e6).cast("long").alias("on_us"), F.round(F.col("off") * 1e6).cast("long").alias("off_us"), "merged")


@query(
    f"""with {STIM}, e as (select * from q where kind = 'purchase'), m as (select * from q where kind = 'error'),
r as (select e.chan, e.event, m.event as mark, row_number() over (partition by e.event order by
  case when m.on_ - e.on_ > -36000 and m.on_ - e.on_ < 10800 then 0 else 1 end, abs(m.on_ - e.on_), m.on_, m.event) as r from e left join m using (chan))
select chan, event, mark from r where r = 1"""
)
def nearest_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stims(spark, sf_dir)
    marks = s.where("kind = 'error'").select("chan", F.col("event").alias("mark"), F.col("on").alias("at"))
    return P.nearest(s.where("kind = 'purchase'"), marks, ("chan",), -36000.0, 10800.0).select("chan", "event", "mark")


@query(f"with {STIM} select chan, event, cast(round((select min(b.on_) from q b where b.chan = q.chan and b.on_ > q.off_ + 1e-6) * 1e6) as bigint) as next_us from q")
def next_stim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.next_onset(stims(spark, sf_dir), ("chan",)).select("chan", "event", F.when(F.col("next_on") < float("inf"), F.round(F.col("next_on") * 1e6)).cast("long").alias("next_us"))


@query(f"with {STIM}, s as (select * from q where kind = 'error') select s.event as stim, v.event_id, cast(round((v.t - s.on_) * 1e6) as bigint) as rel_us from s join ev v on v.chan = s.chan and v.t >= s.on_ - 20000 and v.t <= s.off_ + 20000")
def clip_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stims(spark, sf_dir).where("kind = 'error'").select("chan", F.col("event").alias("stim"), "on", (F.col("on") - 20000).alias("a"), (F.col("off") + 20000).alias("b"))
    found = P.within(samples(spark, sf_dir), s, ("chan",), "t", "a", "b", 40000.0)
    return found.select("stim", "event_id", F.round((F.col("t") - F.col("on")) * 1e6).cast("long").alias("rel_us"))


@query(f"with {STIM} select chan, array_to_string(list_transform(list_sort(list(cast(round(on_ * 1e6) as bigint))), lambda v: v::varchar), ';') as onsets from q where kind = 'error' group by chan")
def stim_time_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stims(spark, sf_dir).where("kind = 'error'").groupBy("chan").agg(F.sort_array(F.collect_list(F.round(F.col("on") * 1e6).cast("long"))).alias("o"))
    return s.select("chan", F.array_join(F.transform("o", lambda x: x.cast("string")), ";").alias("onsets"))


EVAL = STIM + """, s as (select chan, event, on_, on_ + 86400 as off_ from q where kind = 'error'), a as (select chan, t from ev where x > 45),
d as (select s.chan, s.event, s.on_, min(a.t) as first_t from s left join a on a.chan = s.chan and a.t >= s.on_ and a.t <= s.off_ + 5 group by 1, 2, 3)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stims(spark, sf_dir).where("kind = 'error'").select("chan", "event", "on", (F.col("on") + 86400 + 5).alias("until"))
    a = samples(spark, sf_dir).where("x > 45").select("chan", "t")
    hits = P.within(a, s, ("chan",), "t", "on", "until", 86400.0).groupBy("event").agg(F.min("t").alias("first_t"))
    return s.join(hits, "event", "left")


@query(f"with {EVAL} select event, first_t is not null as detected, cast(round((first_t - on_) * 1e6) as bigint) as latency_us from d")
def window_detect_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("event", F.col("first_t").isNotNull().alias("detected"), F.round((F.col("first_t") - F.col("on")) * 1e6).cast("long").alias("latency_us"))


# Evaluation


CLIPS = "c as (select doc_id, source, quality = 1 as truth, n_chars::double as score, toxic from labels join documents using (doc_id))"


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, d = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return l.join(d, "doc_id").select("doc_id", "source", (F.col("quality") == 1).alias("truth"), F.col("n_chars").cast("double").alias("score"), "toxic")


RATES = """tp, fn, fp, tn, round({0}, 9) as sens, round({1}, 9) as spec, round({2}, 9) as ppv, round({3}, 9) as fpr, round({4}, 9) as acc"""
COUNTS = "count(*) filter (where truth and p) as tp, count(*) filter (where truth and not p) as fn, count(*) filter (where not truth and p) as fp, count(*) filter (where not truth and not p) as tn"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: S.rounded(c, 9) for c in ("sens", "spec", "ppv", "fpr", "acc")})


@query(
    f"with {CLIPS}, n as (select source, {COUNTS} from (select *, score > 1500 as p from c) group by source) select source, "
    + RATES.format("tp / nullif(tp + fn, 0)", "tn / nullif(tn + fp, 0)", "tp / nullif(tp + fp, 0)", "fp / nullif(fp + tn, 0)", "(tp + tn) / nullif(tp + fn + fp + tn, 0)")
    + " from n"
)
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.confusion(clips(spark, sf_dir), F.col("truth"), F.col("score") > 1500, ("source",)))


@query(
    f"with {CLIPS}, n as (select {COUNTS} from (select *, score > 1500 as p from c)) select "
    + RATES.format("tp / greatest(tp + fn, 1)", "tn / greatest(tn + fp, 1)", "tp / greatest(tp + fp, 1)", "fp / greatest(fp + tn, 1)", "(tp + tn) / greatest(tp + fn + fp + tn, 1)")
    + " from n"
)
def confusion_clip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.confusion(clips(spark, sf_dir), F.col("truth"), F.col("score") > 1500, empty="zero"))


@query(
    f"""with {CLIPS} select count(*) filter (where not truth and score > 1500) as fp, round(count(*) filter (where not truth and score > 1500) / (sum(score) / 60.0), 9) as per_min_all,
round(count(*) filter (where not truth and score > 1500) / (sum(score) filter (where not truth and toxic = 0) / 60.0), 9) as per_min_negative from c"""
)
def fp_per_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both exposures: over all scored clips (streaming report), and over evaluable negative ones (clip report)."""
    fp = F.sum((~F.col("truth") & (F.col("score") > 1500)).cast("long"))
    negative = F.sum(F.when(~F.col("truth") & (F.col("toxic") == 0), F.col("score")))
    return clips(spark, sf_dir).agg(fp.alias("fp"), S.rounded(fp / (F.sum("score") / 60.0), 9).alias("per_min_all"), S.rounded(fp / (negative / 60.0), 9).alias("per_min_negative"))


@query(
    f"""with {EVAL}, e as (select first_t - on_ as error from d where first_t is not null), v as (select list_sort(list(error)) as s, count(*) as n, median(error) as median from e),
p as (select n, median, s, greatest(1, least(n, 0.25 * n + 0.5)) as a, greatest(1, least(n, 0.75 * n + 0.5)) as b from v)
select n, round(median, 4) as median, round(s[floor(a)::int] + (s[least(n, floor(a)::int + 1)] - s[floor(a)::int]) * (a - floor(a)), 4) as q25,
       round(s[floor(b)::int] + (s[least(n, floor(b)::int + 1)] - s[floor(b)::int]) * (b - floor(b)), 4) as q75 from p"""
)
def onset_error_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = detections(spark, sf_dir).where("first_t is not null").select((F.col("first_t") - F.col("on")).alias("error"))
    return V.onset_error(e).select("n", *(S.rounded(c, 4).alias(c) for c in ("median", "q25", "q75")))


SCAN = CLIPS + """, h as (select distinct score as threshold from c union select min(score) - 1 from c),
k as (select threshold, (count(*) filter (where truth and score > threshold)) / (count(*) filter (where truth)) as sens,
             (count(*) filter (where not truth and score <= threshold)) / (count(*) filter (where not truth)) as spec from h, c group by threshold)"""


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.histogram(clips(spark, sf_dir), F.col("truth"), F.col("score"))


def rates(df: DataFrame) -> DataFrame:
    return df.select("threshold", S.rounded("sens", 9).alias("sens"), S.rounded("spec", 9).alias("spec"))


@query(f"with {SCAN} select threshold, round(sens, 9) as sens, round(spec, 9) as spec from k order by round(sens + spec - 1, 12) desc, threshold limit 1")
def youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(V.best_threshold(score_histogram(spark, sf_dir)))


@query(f"with {SCAN} select threshold, round(sens, 9) as sens, round(spec, 9) as spec from k where spec >= 0.9 order by sens desc, threshold limit 1")
def sens_at_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(V.at_specificity(score_histogram(spark, sf_dir), 0.9))


@query(f"with {CLIPS} select round(avg(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0.0 end), 9) as auc from c a, c b where a.truth and not b.truth")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.roc_auc(score_histogram(spark, sf_dir)).select(S.rounded("auc", 9).alias("auc"))


LOPO = CLIPS + """, g as (select distinct source as fold from c), t as (select fold, c.* from g join c on c.source <> g.fold),
h as (select distinct fold, score as threshold from t union select fold, min(score) - 1 from t group by fold),
k as (select h.fold, threshold, (count(*) filter (where truth and score > threshold)) / nullif(count(*) filter (where truth), 0) as sens,
             (count(*) filter (where not truth and score <= threshold)) / nullif(count(*) filter (where not truth), 0) as spec from h join t on t.fold = h.fold group by 1, 2),
f as (select fold as source, coalesce(max(threshold) filter (where r = 1), 1500) as threshold from (
  select *, row_number() over (partition by fold order by round(sens + spec - 1, 12) desc nulls last, threshold) as r from k where sens is not null and spec is not null) group by fold)"""


@query(f"with {LOPO} select * from f")
def lopo_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.leave_one_out(clips(spark, sf_dir), F.col("truth"), F.col("score"), "source", 1500.0)


@query(f"with {LOPO}, n as (select {COUNTS} from (select c.*, c.score > f.threshold as p from c join f using (source))) select tp, fn, fp, tn, (select median(threshold) from f) as suggested from n")
def lopo_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled counts with each clip judged by its fold's threshold, and the median of thresholds."""
    c = clips(spark, sf_dir)
    folds = V.leave_one_out(c, F.col("truth"), F.col("score"), "source", 1500.0)
    suggested = folds.agg(F.median("threshold")).first()[0]
    n = V.confusion(c.join(folds, "source"), F.col("truth"), F.col("score") > F.col("threshold"), empty="zero")
    return n.select("tp", "fn", "fp", "tn", F.lit(suggested).cast("double").alias("suggested"))


@query(
    f"""with {CLIPS}, x as (select *, not (truth and (coalesce(score / 100 < 5, false) or (toxic = 0 and coalesce(score % 97 < 3, false)))) as ev from c)
select doc_id, case when not ev then 'excluded' when truth and score > 1500 then 'TP' when truth then 'FN' when score > 1500 then 'FP' else 'TN' end as cls from x"""
)
def classify_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    # In hundredths of a second, whole numbers: an onset in seconds added and taken away again would leave 3 seconds a bit short.
    onset = F.col("score")
    ok = V.evaluable(F.col("truth"), onset, onset + F.col("score") % 97 * 100, F.lit(500.0), F.col("toxic"), 300.0)
    return clips(spark, sf_dir).select("doc_id", P.classify(F.col("truth"), F.col("score") > 1500, ok).alias("cls"))


@query(
    f"""with {STIM}, s as (select chan, event, case when event % 3 = 0 then 'u' when event % 3 = 1 then 'y' else 'n' end as ad, on_, on_ + 3600 as off_ from q where kind = 'error'),
a as (select chan, t from ev where x > 45),
d as (select b, s.*, (select min(t) from a where a.chan = s.chan and a.t >= on_ and a.t <= off_ + 86400) as det from s, unnest([100, 250, 500, 1000]) as u(b)),
n as (select b, count(*) filter (where ad = 'y' and det is not null) as tp, count(*) filter (where ad = 'y' and det is null) as fn, count(*) filter (where ad = 'n' and det is not null) as fp, count(*) filter (where ad = 'n' and det is null) as tn,
  sum((off_ + 86400 - on_) / 60) as minutes, median(det - (on_ + 60)) filter (where ad = 'y') as onset_median from d group by b)
select b::integer as block_ms, tp, fn, fp, tn, round(tp / nullif(tp + fn, 0), 9) as sens, round(tn / nullif(tn + fp, 0), 9) as spec, round(tp / nullif(tp + fp, 0), 9) as ppv, round(fp / nullif(fp + tn, 0), 9) as fpr,
  round((tp + tn) / nullif(tp + fn + fp + tn, 0), 9) as acc, round(onset_median, 4) as onset_median, round(fp / minutes, 9) as fp_per_min from n"""
)
def block_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation of event logs of four block sizes: one row of metrics for each. Loud events are the log, and the same for all sizes, as a detector's is that doesn't wait for a block's end (``block_latency`` evaluates one that does)."""
    s = stims(spark, sf_dir).where("kind = 'error'").select("chan", F.col("event").alias("clip"), "on", (F.col("on") + 3600).alias("off"))
    told = F.when(F.col("clip") % 3 == 0, "u").when(F.col("clip") % 3 == 1, "y").otherwise("n")
    marks = s.select("clip", told.alias("AD"), (F.col("on") + 60).alias("AD_onset"), F.col("on").alias("stimOn"), F.col("off").alias("stimOff"))
    loud = samples(spark, sf_dir).where("x > 45").select("chan", "t")
    near = P.within(loud, s.select("chan", "clip", "on", (F.col("off") + 86400).alias("until")), ("chan",), "t", "on", "until", 86400.0).select("clip", "t")
    log = near.union(s.select("clip", F.lit(None).cast("double")))  # clips without an event were replayed too
    sized = log.withColumn("block_ms", F.explode(F.array(*(F.lit(b) for b in (100, 250, 500, 1000)))))
    m = studies.evaluate(sized, marks, ("block_ms",), post=86400.0)[1]
    return rounded(m).select("block_ms", "tp", "fn", "fp", "tn", "sens", "spec", "ppv", "fpr", "acc", S.rounded("onset_median", 4).alias("onset_median"), S.rounded("fp_per_min", 9).alias("fp_per_min"))


HAZEN = lambda name, p: f"list_sort(list({name}) filter (where {name} is not null))[greatest(1, least(count({name}), floor({p} * count({name}) + 0.5)))::int] + (list_sort(list({name}) filter (where {name} is not null))[least(count({name}), greatest(1, floor({p} * count({name}) + 0.5)) + 1)::int] - list_sort(list({name}) filter (where {name} is not null))[greatest(1, least(count({name}), floor({p} * count({name}) + 0.5)))::int]) * (greatest(1, least(count({name}), {p} * count({name}) + 0.5)) - floor(greatest(1, least(count({name}), {p} * count({name}) + 0.5))))"


@query(
    f"""with {STIM}, s as (select chan, event, case when event % 3 = 0 then 'u' when event % 3 = 1 then 'y' else 'n' end as ad, on_, on_ + 3600 as off_ from q where kind = 'error'),
a as (select chan, b, (floor(t / (b * 3600)) + 1) * (b * 3600) as t from ev, unnest([1, 6, 12, 24]) as u(b) where x > 45),
d as (select b, s.*, (select min(t) from a where a.b = u.b and a.chan = s.chan and a.t >= on_ and a.t <= off_ + 86400) as det from s, unnest([1, 6, 12, 24]) as u(b)),
n as (select *, case when ad = 'y' then det - (on_ + 60) end as late from d)
select b::integer as block_hours, count(*) filter (where ad = 'y' and det is not null) as tp, count(*) filter (where ad = 'y' and det is null) as fn, count(*) filter (where ad = 'n' and det is not null) as fp, count(*) filter (where ad = 'n' and det is null) as tn,
  round(median(late), 4) as onset_median, round({HAZEN("late", 0.25)}, 4) as onset_q25, round({HAZEN("late", 0.75)}, 4) as onset_q75 from n group by b"""
)
def block_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector that reports at the end of its block, for blocks of four sizes: counts and quartiles of onset errors."""
    s = stims(spark, sf_dir).where("kind = 'error'").select("chan", F.col("event").alias("clip"), "on", (F.col("on") + 3600).alias("off"))
    told = F.when(F.col("clip") % 3 == 0, "u").when(F.col("clip") % 3 == 1, "y").otherwise("n")
    marks = s.select("clip", told.alias("AD"), (F.col("on") + 60).alias("AD_onset"), F.col("on").alias("stimOn"), F.col("off").alias("stimOff"))
    sizes = F.explode(F.array(*(F.lit(b) for b in (1, 6, 12, 24))))
    loud = samples(spark, sf_dir).where("x > 45").select("chan", "t", sizes.alias("block_hours")).select("chan", "block_hours", ((F.floor(F.col("t") / (F.col("block_hours") * 3600)) + 1) * (F.col("block_hours") * 3600)).cast("double").alias("t")).distinct()
    replayed = s.select("chan", "clip", "on", (F.col("off") + 86400).alias("until"), sizes.alias("block_hours"))
    near = P.within(loud, replayed, ("chan", "block_hours"), "t", "on", "until", 86400.0).select("block_hours", "clip", "t")
    log = near.union(replayed.select("block_hours", "clip", F.lit(None).cast("double")))
    m = studies.evaluate(log, marks, ("block_hours",), post=86400.0)[1]
    return m.select("block_hours", "tp", "fn", "fp", "tn", *(S.rounded(c, 4).alias(c) for c in ("onset_median", "onset_q25", "onset_q75")))


# Sources and sinks


def plans(orders: DataFrame) -> DataFrame:
    r = orders.select("o_orderkey", (1 + F.col("o_custkey") % 130).alias("channels"), (F.col("o_totalprice") / 1000).alias("start"), (F.col("o_totalprice") / 1000 + 600).alias("end"))
    return T.plan_chunks(r, rate=500, key="o_orderkey", share=20).select("o_orderkey", "first_sample", "last_sample")


@query(
    """with o as (select o_orderkey, 1 + o_custkey % 130 as n_ch, o_totalprice / 1000 as t0, o_totalprice / 1000 + 600 as t1 from orders),
p as (select o_orderkey, cast(round(t0 * 500) as bigint) as s0, cast(round(t1 * 500) as bigint) as s1, greatest(500, cast(floor(0.8 * 1.3e8 / n_ch) as bigint)) // 20 as step from o)
select o_orderkey, k as first_sample, least(k + step, s1) - 1 as last_sample from (select *, unnest(range(s0, s1, step)) as k from p)"""
)
def chunk_planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans for every recording."""
    return plans(read(spark, sf_dir, "orders"))


@query(
    """with m as (select vec_id, floor(list_min(embedding)::double * 8) as lo, ceil(list_max(embedding)::double * 8) as hi from embeddings)
select vec_id, greatest(-9999999, least(9999999, lo)) as pmin, greatest(-9999999, least(9999999, case when hi <= lo then lo + 1 else hi end)) as pmax from m"""
)
def edf_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 8).alias("samples"))
    lo, hi = T.physical_range(F.col("samples"))
    return e.select("vec_id", lo.alias("pmin"), hi.alias("pmax"))


@query("select conv_id, role, min(turn) as turn from conversations group by conv_id, role")
def stable_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stable_unique(read(spark, sf_dir, "conversations").select("conv_id", "role", "turn"), ("conv_id", "role"), "turn")


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r = 1")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest_wins(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ("conv_id",), "turn")


@query(
    """select cast(doc_id as varchar) as clip_name, case when quality = 1 then 'y' else 'n' end as "AD", try_cast(case when doc_id % 3 = 0 then 'abc' else cast(doc_id as varchar) end as double) as "AD_onset",
0.0 as ad_ongoing, coalesce(try_cast(toxic as double), 0.0) as stim_problem, cast(null as varchar) as notes from labels"""
)
def gt_schema_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older annotation table: text where numbers belong, columns missing."""
    old = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("clip_name"), F.when(F.col("quality") == 1, "y").otherwise("n").alias("AD"), F.when(F.col("doc_id") % 3 == 0, "abc").otherwise(F.col("doc_id").cast("string")).alias("AD_onset"), F.col("toxic").cast("string").alias("stim_problem"))
    return T.repair_ground_truth(old).select("clip_name", "AD", "AD_onset", "ad_ongoing", "stim_problem", "notes")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber = 4)")
def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return T.not_yet_written(read(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


# Studies


@query(
    f"""with {EV}, q as (select 'S ' || chan as session, 'LA' || event_id % 9 || '-LB1' as pair, t as on_, t + x as off_ from ev where event_type = 'error'),
n as (select *, row_number() over f as event, coalesce(lead(on_) over f, 'inf'::double) as nx from q window f as (partition by session order by on_, off_, pair))
select session, event, regexp_replace(session || '_ev' || lpad(cast(event as varchar), 2, '0') || '_' || pair, '[^\\w-]', '', 'g') as clip,
       cast(round((on_ - 10) * 1e6) as bigint) as start_us, cast(round((off_ + 10) * 1e6) as bigint) as end_us, case when nx < 'inf'::double then cast(round(nx * 1e6) as bigint) end as next_us from n"""
)
def clip_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = samples(spark, sf_dir).where("event_type = 'error'")
    text = lambda c: F.col(c).cast("string")
    s = e.select(F.concat(F.lit("S "), text("chan")).alias("session"), F.concat(F.lit("LA"), (F.col("event_id") % 9).cast("string"), F.lit("-LB1")).alias("pair"), F.col("t").alias("on"), (F.col("t") + F.col("x")).alias("off"))
    us = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return studies.clip_index(s).select("session", "event", "clip", us("clip_start").alias("start_us"), us("clip_end").alias("end_us"), F.when(F.col("next_stim_on") < float("inf"), us("next_stim_on")).alias("next_us"))


RELAY = STIM + """, e as (select *, 'P' || event % 3 as pair from q where kind = 'purchase'), m as (select *, 'P' || event % 2 as pair from q where kind = 'error' and chan % 4 <> 0),
r as (select e.chan, e.event, e.pair, m.event as mark, m.pair as relay_pair, row_number() over (partition by e.event order by
  case when m.on_ - e.on_ > -36000 and m.on_ - e.on_ < 10800 then 0 else 1 end, abs(m.on_ - e.on_), m.on_, m.event) as r from e left join m using (chan)),
o as (select event, mark, case when mark is null then 'no-ann' when pair = relay_pair then 'yes' else 'NO' end as match from r where r = 1)"""


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stims(spark, sf_dir)
    tag = lambda n: F.concat(F.lit("P"), (F.col("event") % n).cast("string"))
    relays = s.where("kind = 'error' and chan % 4 != 0").select("chan", F.col("event").alias("mark"), F.col("on").alias("at"), tag(2).alias("pair"))
    return studies.compare_with_relays(s.where("kind = 'purchase'").withColumn("pair", tag(3)), relays, ("chan",), -36000.0, 10800.0)


@query(f"with {RELAY} select * from o")
def relay_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).select("event", "mark", "match")


@query(f"with {RELAY} select count(*) filter (where match <> 'no-ann') as scored, round(avg((match = 'yes')::int) filter (where match <> 'no-ann'), 9) as rate from o")
def relay_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.match_rate(compared(spark, sf_dir)).select("scored", S.rounded("rate", 9).alias("rate"))


@query("select o_orderkey, least(o_totalprice, o_custkey * 10.0) as onset, case when o_orderstatus = 'F' then 1e6 else greatest(o_totalprice, o_custkey * 10.0) end as offset_ from orders")
def annotation_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    on, off = studies.decision(F.col("o_totalprice"), F.col("o_custkey") * 10.0, F.col("o_orderstatus") == "F", F.lit(1e6))
    return read(spark, sf_dir, "orders").select("o_orderkey", on.alias("onset"), off.alias("offset_"))


JUDGED = CLIPS + """, x as (select *, toxic = 0 or not truth as evaluable from c), g as (select distinct source as fold from x where evaluable),
t as (select fold, x.* from g join x on x.source <> g.fold where x.evaluable),
h as (select distinct fold, score as threshold from t union select fold, min(score) - 1 from t group by fold),
k as (select h.fold, threshold, (count(*) filter (where truth and score > threshold)) / nullif(count(*) filter (where truth), 0) as sens,
             (count(*) filter (where not truth and score <= threshold)) / nullif(count(*) filter (where not truth), 0) as spec from h join t on t.fold = h.fold group by 1, 2),
f as (select fold as source, threshold from (select *, row_number() over (partition by fold order by round(sens + spec - 1, 12) desc, threshold) as r from k where sens is not null and spec is not null) where r = 1),
j as (select x.*, score > coalesce(threshold, 1500) as pred from x left join f using (source))"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clips(spark, sf_dir).withColumnRenamed("source", "patient").withColumn("evaluable", (F.col("toxic") == 0) | ~F.col("truth"))
    return studies.validation_report(c, 1500.0)


@query(f"with {JUDGED} select doc_id, source as patient, truth, evaluable, score, pred from j")
def clip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("doc_id", "patient", "truth", "evaluable", "score", "pred")


@query(f"with {JUDGED} select case when not evaluable then 'excluded' when truth and pred then 'TP' when truth then 'FN' when pred then 'FP' else 'TN' end as category, count(*) as n from j group by 1")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.review_counts(judged(spark, sf_dir))


@query(
    """with a as (select l_orderkey, string_agg(distinct 'L' || l_linenumber, ';') as named from lineitem where l_discount > 0.05 group by 1)
select l_orderkey, l_linenumber, case when list_contains(string_split(coalesce(named, ''), ';'), 'L' || l_linenumber) then case when l_tax > 0.04 then 'both' else 'truth' end when l_tax > 0.04 then 'detector' else 'none' end as agreement
from lineitem left join a using (l_orderkey)"""
)
def channel_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotation names channels in one string; the detector names them one by one."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("chan"))
    named = l.where("l_discount > 0.05").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(F.collect_list("chan")), ";").alias("named"))
    both = l.join(named, "l_orderkey", "left")
    truth = F.array_contains(F.split(F.coalesce("named", F.lit("")), ";"), F.col("chan"))
    return both.select("l_orderkey", "l_linenumber", P.agreement(truth, F.col("l_tax") > 0.04).alias("agreement"))


@query("select page_id, split_part(url, ':', 1) as host, regexp_replace(regexp_replace(url, '^[^:]*:', ''), '/$', '') as folder from pages")
def remote_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, folder = studies.split_remote(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", host.alias("host"), folder.alias("folder"))


@query("select c_custkey, c_name || '_' || c_nationkey as tag from customer")
def session_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", S.session_tag(F.col("c_name"), F.col("c_nationkey")).alias("tag"))


@query(
    """with d as (select o_orderkey, case when o_orderstatus = 'F' then 'y' when o_orderstatus = 'O' then 'n' end as "AD", case when o_orderkey % 5 = 0 then 1.0::double else 0.0::double end as stim_problem, case when o_orderkey % 7 = 0 then 'seen' end as notes from orders)
select * from d where "AD" in ('y', 'n', 'u') or stim_problem <> 0 or coalesce(notes, '') <> ''"""
)
def decided_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions worth keeping of an annotation log."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    d = read(spark, sf_dir, "orders").select("o_orderkey", F.when(status == "F", "y").when(status == "O", "n").alias("AD"), F.when(k % 5 == 0, 1.0).otherwise(0.0).alias("stim_problem"), F.when(k % 7 == 0, "seen").alias("notes"))
    return T.decided(d)


@query(
    """with b as (select distinct s_nationkey * 10.0 as base, 'N' || s_nationkey as chan from supplier),
n as (select c_nationkey, c_custkey, chan from (select c_nationkey, c_custkey, chan, row_number() over (partition by c_custkey order by abs(c_acctbal / 30.0 - base), chan) as r from customer, b) where r = 1),
f as (select c_nationkey, chan, min(c_custkey) as click from n group by 1, 2)
select c_nationkey, string_agg(chan, ';' order by click, chan) as channels from f group by 1"""
)
def clicked_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels that several clicks name, each once, in the order of the clicks."""
    base = read(spark, sf_dir, "supplier").select((F.col("s_nationkey") * 10.0).alias("base"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("chan")).distinct()
    return C.clicked_channels(read(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("click_id"), (F.col("c_acctbal") / 30.0).alias("y")), base, ("c_nationkey",))


@query(
    """with m as (select vec_id, floor(list_min(embedding)::double * 8) as lo, ceil(list_max(embedding)::double * 8) as hi, embedding from embeddings),
p as (select vec_id, lo, case when hi <= lo then lo + 1 else hi end as hi, embedding from m)
select vec_id, list_sum(list_transform(embedding, lambda x: greatest(-32768, least(32767, round((x::double * 8 - lo) / (hi - lo) * 65535 - 32768)))))::bigint as total from p"""
)
def edf_digital(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as the whole numbers of a file; their sum stands for them."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 8).alias("samples"))
    lo, hi = T.physical_range(F.col("samples"))
    d = T.digital(F.col("samples"), lo, hi)
    return e.select("vec_id", F.aggregate(d, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("total"))


# Small parts


ALL_CONTACTS = "ac as (select distinct label, regexp_extract(label, '([A-Za-z]+)([0-9]+)', 1) as e, cast(regexp_extract(label, '([A-Za-z]+)([0-9]+)', 2) as integer) as k from (select replace(n_name, '_', '') as label from nation union all select replace(p_brand, '#', '') from part))"


@query(
    f"""with {ALL_CONTACTS}, s(stim_id, e, x, y) as (values {", ".join(f"({i}, '{e}', {a}, {b})" for i, e, a, b in STIMS)}),
p as (select a.e, a.k, a.label as first, b.label as second from ac a join ac b on a.e = b.e and b.k = a.k + 1)
select stim_id, first, second, abs(p.k + 0.5 - (x + y) / 2.0)::double as away, row_number() over (partition by stim_id order by abs(p.k + 0.5 - (x + y) / 2.0), p.k, p.e) as rank
from p cross join s where not (p.e = s.e and (p.k in (x, y) or p.k + 1 in (x, y))) qualify rank <= 4"""
)
def candidate_pairs_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest pairs of any electrode of the recording."""
    labels = nations(spark, sf_dir).union(read(spark, sf_dir, "part").select(F.replace("p_brand", F.lit("#"), F.lit("")))).distinct()
    one = F.lit(0).alias("recording")
    stims_ = spark.createDataFrame(STIMS, "stim_id long, electrode string, a int, b int").select("*", one)
    return C.candidates(C.pairs(labels.select(one, "label"), ("recording",)), stims_, 4, ("recording",), same_electrode=False)


@query("select doc_id, trim(replace(text, chr(10), ' ')) as notes from documents")
def notes_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as notes of several lines."""
    return read(spark, sf_dir, "documents").select("doc_id", T.joined_notes(F.split("text", "\n")).alias("notes"))


@query("select o_orderpriority as ieeg_name, o_orderkey::double as \"Modifier\", o_totalprice / 1000 as start, o_totalprice / 1000 + 600 as \"end\" from orders")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session list written as CSV and read back, with another name of its end column."""
    path = new_path(spark, "sessions")
    price = F.col("o_totalprice") / 1000
    T.write_csv(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ieeg_name"), F.col("o_orderkey").alias("Modifier"), price.alias("start"), (price + 600).alias("xEnd")), path)
    return T.read_sessions(spark, path).select("ieeg_name", F.col("Modifier").cast("double").alias("Modifier"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))


@query(f"with {EV} select chan, i, i // 5 as win from (select *, count(*) over (partition by chan) as n from ev) where (i // 5 + 1) * 5 <= n - 1")
def windows_without_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as the stimulation finder takes them: a last one that ends with the channel isn't looked at."""
    return G.tumble(samples(spark, sf_dir), 5, last="drop").select("chan", "i", "win")
