"""Queries that need Python: the detector as a stream, files of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.catalogue import EVENT_LOG_SQL, RULE, query, read, samples
from ..sources import eeg, files
from ..sources.shared import new_path
from . import annotations, channels


def vector_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as recordings: eight of them are the channels of a clip of one second."""
    e = read(spark, sf_dir, "embeddings").where("embedding is not null")
    chan = (F.col("vec_id") % 8).cast("int")
    return e.select(F.concat(F.lit("clip"), F.floor(F.col("vec_id") / 8).cast("string")).alias("clip"), chan.alias("chan"), F.concat(F.lit("LA"), (chan + 1).cast("string")).alias("label"), F.lit(64.0).alias("rate"), F.lit(0).cast("long").alias("first_sample"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))


@query()
def edf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips as files: their sizes and digests."""
    e = eeg.to_edf(vector_clips(spark, sf_dir))
    return e.select("clip", F.octet_length("edf").alias("n_bytes"), F.sha2("edf", 256).alias("sha256"))


@query()
def edf_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips written as committed files in two runs, of which the second skips what the first wrote, and read back."""
    path = new_path(spark, "edf-files")
    clips = vector_clips(spark, sf_dir).withColumn("name", F.concat("clip", F.lit(".edf")))
    for chosen in (clips.where(F.crc32("name") % 2 == 0), clips):
        made = eeg.to_edf(files.new_only(chosen, path))
        files.write_files(made.select(F.concat("clip", F.lit(".edf")).alias("name"), F.col("edf").alias("content")), path)
    found = files.read_files(spark, path)
    return found.select(F.regexp_replace("name", "[.]edf$", "").alias("clip"), F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@query(EVENT_LOG_SQL)
def rt_detector_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector's log of ``rt_detector_batch``, from a stream of files with state for each channel."""
    s = samples(spark, sf_dir)
    ts = F.expr("timestamp_micros(cast(round(t * 1000000) as bigint))")
    found = channels.replay(s.select("chan", "event_id", ts.alias("ts"), "t", F.col("x").alias("power")), RULE)
    return found.select("chan", "kind", "i", S.rounded("t", 3).alias("t"), "stim")


@query("select user_id as clip, event_type as decision from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def annotation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as annotations of clips (users) that arrive in files: the current decision of each, after a stream of upserts."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), F.col("event_type").alias("decision"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id").alias("turn"))
    source, path, checkpoint = (new_path(spark, n) for n in ("annotations", "annotation-versions", "annotation-state"))
    e.repartition(6, "turn").write.parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(source)
    annotations.follow(stream, path, checkpoint, ("clip",), "turn")
    found = annotations.current(spark, path, ("clip",), "turn")
    return found.select("clip", "decision")
