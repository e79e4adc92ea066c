"""Tables of a study: sessions, chunk plans, annotations, EDF ranges; incremental writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.patterns import first_per

#: The columns of the session list and of the annotation table.
SESSIONS = T.StructType([T.StructField(n, k) for n, k in (("ieeg_name", T.StringType()), ("Modifier", T.IntegerType()), ("start", T.DoubleType()), ("end", T.DoubleType()), ("obv_sz", T.StringType()), ("obv_ad", T.StringType()), ("notes", T.StringType()))])
GROUND_TRUTH = {
    "clip_name": "string", "ieeg_name": "string", "stim_pair": "string", "stimOn": "double", "stimOff": "double", "AD": "string", "AD_onset": "double",
    "AD_offset": "double", "ad_ongoing": "double", "AD_channels": "string", "stim_problem": "double", "Annotator": "string", "notes": "string",
}
#: Columns in which missing means no.
FLAGS = ("ad_ongoing", "stim_problem")
#: Most a request may ask for: rate x channels x seconds, used to four fifths.
REQUEST, SAFETY = 1.3e8, 0.8
EDF_LIMIT = 9_999_999


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The session list; its end column may have another name in another case."""
    found = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in found.columns}
    end = names.get("end") or names.get("xend")
    if end is None:
        raise ValueError("the session list has no end column")
    cols = [F.col(end if f.name == "end" else names.get(f.name.lower(), f.name)).try_cast(f.dataType).alias(f.name) if f.name == "end" or f.name.lower() in names else F.lit(None).cast(f.dataType).alias(f.name) for f in SESSIONS]
    return found.select(*cols)


def write_csv(table: DataFrame, path: str) -> None:
    """A result or session list as CSV with a header, quoted so that any text reads back; missing values are empty, empty texts quoted."""
    table.write.option("header", True).option("escape", '"').option("quoteAll", False).option("emptyValue", '""').option("nullValue", "").mode("overwrite").csv(path)


def joined_notes(lines: Column) -> Column:
    """Lines of a note (an array; null is none) as one text."""
    return F.trim(F.array_join(F.coalesce(lines, F.array().cast("array<string>")), " "))


def samples_per_request(rate: Column | float, channels: Column) -> Column:
    one_second = F.round(F.lit(rate) if not isinstance(rate, Column) else rate).cast("long")
    return F.greatest(one_second, F.floor(SAFETY * REQUEST / channels).cast("long"))


def plan_chunks(ranges: DataFrame, rate: float, key: str, share: int = 1) -> DataFrame:
    """Requests that cover each range of seconds, [start, end): ``first_sample`` and ``last_sample``, at most a ``share``-th of a full request each."""
    s0, s1 = (F.round(F.col(c) * rate).cast("long") for c in ("start", "end"))
    r = ranges.select(key, s0.alias("s0"), s1.alias("s1"), samples_per_request(rate, F.col("channels")).alias("step"))
    r = r.withColumn("step", F.expr(f"step div {share}L")).where("s1 > s0")
    firsts = r.withColumn("first_sample", F.explode(F.sequence("s0", F.col("s1") - 1, F.col("step"))))
    return firsts.select(key, "first_sample", (F.least(F.col("first_sample") + F.col("step"), F.col("s1")) - 1).alias("last_sample"))


def physical_range(samples: Column) -> tuple[Column, Column]:
    """Whole numbers around the samples, at least 1 apart, within what the header can hold. Missing samples count as 0."""
    filled = F.transform(samples, lambda x: F.coalesce(x, F.lit(0.0)))
    low, high = F.floor(F.array_min(filled)).cast("double"), F.ceil(F.array_max(filled)).cast("double")
    high = F.when(high <= low, low + 1).otherwise(high)
    clamp = lambda c: F.greatest(F.lit(-float(EDF_LIMIT)), F.least(F.lit(float(EDF_LIMIT)), c))
    return clamp(low), clamp(high)


def digital(samples: Column, low: Column, high: Column) -> Column:
    """Samples as 16-bit whole numbers of the range."""
    return F.transform(samples, lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round((F.coalesce(x, F.lit(0.0)) - low) / (high - low) * 65535 - 32768))).cast("short"))


def repair_ground_truth(found: DataFrame) -> DataFrame:
    """Any version of the annotation table with all columns, of the right types, in order. Missing flags are 0."""
    cols = []
    for name, kind in GROUND_TRUTH.items():
        c = F.col(name).try_cast(kind) if name in found.columns else F.lit(None).cast(kind)
        cols.append((F.coalesce(c, F.lit(0.0)) if name in FLAGS else c).alias(name))
    return found.select(*cols)


def latest_wins(log: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The current row of each key of an append-only log."""
    others = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("x")).select(*keys, "x.*")


def upsert(now: DataFrame, new: DataFrame, key: str = "clip_name") -> DataFrame:
    """``now`` with rows of ``new`` in the place of those with the same key."""
    return now.join(new.select(key), key, "left_anti").select(now.columns).unionByName(new, allowMissingColumns=True)


def decided(decisions: DataFrame) -> DataFrame:
    """Decisions worth keeping: an answer, a flag or a note."""
    return decisions.where("AD in ('y', 'n', 'u') or stim_problem != 0 or coalesce(notes, '') != ''")


def stable_unique(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The first row of each key, by ``order``."""
    return first_per(rows, keys, (order,))


def not_yet_written(rows: DataFrame, written: DataFrame, key: str) -> DataFrame:
    return rows.join(written.select(key).distinct(), key, "left_anti")
