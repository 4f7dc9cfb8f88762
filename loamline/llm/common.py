"""What the corpus operators share: reading tables, shared scratch tables, runs of sorted rows."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch, or of the part of one that a task turns into Python objects at a time (or one row, if that is larger).
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile sends Python Arrow batches of BATCH_BYTES: one of Spark's own (64 MB, or 10,000 rows) is held by the JVM, twice over as it grows, and by the worker, for each of an executor's cores."""
    before = spark.conf.get(_BATCH_CONF, None)
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_CONF)
        else:
            spark.conf.set(_BATCH_CONF, before)


def parts(batches: Iterator[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in batches of so many bytes at most, or of one row."""
    for b in batches:
        todo = [b]
        del b
        while todo:
            part = todo.pop()
            if part.nbytes > size and part.num_rows > 1:
                half = part.num_rows // 2
                todo += part.slice(half), part.slice(0, half)
            else:
                yield part
            del part


def lean(of: Callable) -> Callable:
    """A function for mapInArrow that gets parts() of the batches; at a task's end its worker, which stays for the next stage, gives back what it no longer uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from of(parts(batches))
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:  # glibc
                trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests on one machine) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="loamline-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it again: lineage ends here, and a lost executor costs no recomputation. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loamline/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with small_batches(spark):
        writer.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a stored() frame that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def marks(rows: DataFrame, row: str, name: str) -> DataFrame:
    """Which row numbers (none negative; they may repeat) are in rows, stored for marked(): bits, 64 neighbouring numbers to a line."""
    bit = F.expr(f"shiftleft(1L, cast(`{row}` & 63 as int))")
    return stored(rows.groupBy(F.shiftright(F.col(row), 6).alias("loamline_line")).agg(F.bit_or(bit).alias("loamline_bits")), name)


def marked(rows: DataFrame, row: str, which: DataFrame, wanted: bool) -> DataFrame:
    """The rows whose number is (or, not wanted, is not) among those marked. The marks are broadcast, at most a line for 64 rows; the rows, however wide, stay where they are."""
    at = rows.join(F.broadcast(which), F.shiftright(F.col(row), 6) == F.col("loamline_line"), "inner" if wanted else "left")
    bit = F.expr(f"shiftright(coalesce(loamline_bits, 0L), cast(`{row}` & 63 as int)) & 1")
    return at.where(bit == int(wanted)).drop("loamline_line", "loamline_bits")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: str = "text"):
    """A text column's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")
