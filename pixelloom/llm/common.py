"""Small helpers shared by the training-data operators: tables, words, scratch tables of steps, workers' memory. Null columns stay null in
``ascii_lower``; empty tables are saved and read again with their schema."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Class of word characters: everything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Python source for the same class.
WORD_PY = r"[^\x20\x09-\x0d]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    """Lower-cases A-Z only; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a local session gets a temporary one; a cluster's
    executors couldn't see it, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("pixelloom.local.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pixelloom-")
        spark.conf.set("pixelloom.local.dir", at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the scratch tables of steps that have begun and not ended, innermost last.
_begun: list[list[str]] = []


def put(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and rereads it; and where it is."""
    path = scratch(df.sparkSession, name)
    if _begun:
        _begun[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and rereads it: lineage is cut, and lost executors lose nothing."""
    return put(df, name)[0]


@contextmanager
def step(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Removes, at its end, the scratch tables that were saved since; what outlasts it is saved by the function that it gives."""
    _begun.append([])

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = put(df, name)
        own = _begun[-1]
        own.remove(path)
        if len(_begun) > 1:
            _begun[-2].append(path)
        return out

    try:
        yield keep
    finally:
        drop_saved(spark, *_begun.pop())


def drop_saved(spark: SparkSession, *paths: str) -> None:
    """Removes scratch tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files of finished steps: Spark removes them when the driver's JVM collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows that a worker gets at once: whole texts, so some megabytes.
RECORDS = 1000


def tidy() -> None:
    """Gives a worker's free memory back: workers live on, idle or for other steps, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


#: What workers remember from task to task, by the steps that it serves.
_remembered: dict[str, dict] = {}


def memory(owner: str) -> dict:
    """A dictionary that a worker keeps until a task of other steps begins."""
    return _remembered.setdefault(owner, {})


def turn_to(owner: str) -> None:
    """Lets go of what other steps remember. (A function of the module: in the worker it sees the worker's own dictionaries.)"""
    for name, kept in _remembered.items():
        if name != owner:
            kept.clear()


def mapped(run: Callable, schema, owner: str = "") -> Callable[[DataFrame], DataFrame]:
    """mapInArrow for ``DataFrame.transform``: batches of at most RECORDS rows, memory given back at the end of a task, and what other
    steps than ``owner`` remember let go of at its beginning."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(owner)
        try:
            yield from run(batches)
        finally:
            tidy()

    def apply(df: DataFrame) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if int(df.sparkSession.conf.get(key)) > RECORDS:
            df.sparkSession.conf.set(key, str(RECORDS))
        return df.mapInArrow(over, schema)

    return apply


def width(spark: SparkSession) -> int:
    """How many partitions a shuffle should have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
