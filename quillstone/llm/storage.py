"""Reading the tables, and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import reduce, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that is still broadcast.
MOST_BROADCAST = 48 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset (tests on one machine) a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table by a checkpoint that survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Paths of tables staged inside ``noted``, else nobody's.
_NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """The paths of tables that are staged meanwhile are added to ``paths``."""
    token = _NOTED.set(paths)
    try:
        yield
    finally:
        _NOTED.reset(token)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder as Parquet and read it back, so that later scans prune its columns."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if (paths := _NOTED.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int:
    """An upper estimate of a checkpointed table's size in memory."""
    strings = [F.octet_length(f.name) for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.agg(F.sum(reduce(Column.__add__, strings, F.lit(16 + 16 * len(df.columns))))).first()[0] or 0


def small(df: DataFrame, size: int) -> DataFrame:
    """Broadcast while it is under its bound; beyond, a shuffled join that AQE can split."""
    return F.broadcast(df) if size <= MOST_BROADCAST else df


def same(a: str, b: str, names: list[str]) -> Column:
    """The rows named ``a`` and ``b`` agree in ``names``, nulls included."""
    return reduce(Column.__and__, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def small_batches(spark: SparkSession, rows: int = 500, size: int = 16 << 20) -> None:
    """Bound the rows and the bytes of an Arrow batch, so that a batch of very long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def give_back() -> None:
    """Free memory of a Python worker goes back to the system: workers live on, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not this C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, with ``give_back`` at its end."""

    @wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy
