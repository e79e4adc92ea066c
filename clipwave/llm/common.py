"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts can be long, so the default of 10,000 is too many.
ARROW_ROWS = 500
#: Bytes of text that a task turns into Python objects at once (a longer text comes alone).
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the one that
    was set on the context. Where neither is set, a new one on one machine (tests), an error
    on a cluster."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut in the lineage
    that survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_clear: dict[str, Callable[[], None]] = {}
_end: dict[str, Callable[[], None]] = {}
_owner: list[str] = [""]


def tables_of(operator: str, clear: Callable[[], None], end: Callable[[], None] | None = None) -> None:
    """Say how to let go of what an operator keeps in a Python worker: all of it (``clear``), and what a task leaves behind (``end``)."""
    _clear[operator] = clear
    if end:
        _end[operator] = end


def begin(operator: str) -> None:
    """A task of ``operator`` begins. Spark hands workers on from one operator to the next;
    tables of others go, and freed memory goes back to the system."""
    if _owner[0] == operator:
        return
    _owner[0] = operator
    for name, clear in _clear.items():
        if name != operator:
            clear()
    give_back()


def finish(operator: str) -> None:
    """A task of ``operator`` is at its end."""
    if operator in _end:
        _end[operator]()
    give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about CHUNK_BYTES of text (or of lists of longs), or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        lengths = pc.multiply(pc.list_value_length(column), 8) if pa.types.is_list(column.type) else pc.binary_length(column)
        sizes = pc.fill_null(lengths, 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > CHUNK_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", operator: str = "") -> DataFrame:
    """``mapInArrow`` with ``work`` applied to slices of bounded size.

    Arrow's batches keep ARROW_ROWS rows for the rest of the session: plans are lazy, so the
    setting can't be taken back here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(operator)
        for part in slices(batches, text):
            if (out := work(part)) is not None:
                yield out
        finish(operator)

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df.mapInArrow(run, schema)


def training_rows(found: DataFrame, most: int, name: str) -> pa.Table:
    """The distinct rows of features and label, about ``most`` of them if there are more (by
    their hash): the one table of a fit that reaches the driver, whatever repeats."""
    rows = materialize(found.distinct(), name)
    share = most / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)) < int(share * (1 << 20)))
    return rows.toArrow()


def fold(column: str, parts: int):
    """crc32 of the column as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
