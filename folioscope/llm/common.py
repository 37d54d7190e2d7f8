"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        cached = getattr(sys, "_folioscope_shared", None)
        if cached is None:
            cached = sys._folioscope_shared = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        found = cached
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage ends there, and no executor's loss costs it.

    The files go with discard(), at the end of a scratch() block, or when the application ends.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioscope_path = path
    for block in _blocks[-1:]:
        block.append(out)
    return out


def discard(table: DataFrame) -> None:
    """Deletes the files of a stored table that nothing will read any more."""
    path = getattr(table, "_folioscope_path", None)
    if path:
        fs, at = _file_system(table.sparkSession, path)
        fs.delete(at, True)
        fs.cancelDeleteOnExit(at)
        table._folioscope_path = None


_blocks: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Discards at its end what was stored inside, but for keep(table)."""
    _blocks.append([])
    try:
        yield
    finally:
        for table in _blocks.pop():
            discard(table)


def keep(table: DataFrame) -> DataFrame:
    """Takes a stored table out of the innermost scratch block, into the one around it."""
    if _blocks:
        _blocks[-1][:] = [t for t in _blocks[-1] if t is not table]
        for block in _blocks[-2:-1]:
            block.append(table)
    return table


def worker_cache(key: Any, make: Callable[[], Any]) -> Any:
    """One object per Python process; it survives between tasks that a reused worker runs."""
    cache = sys.__dict__.setdefault("_folioscope_cache", {})
    if key not in cache:
        cache[key] = make()
    return cache[key]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which at the end of a task gives the memory that it freed back to the machine: workers live on between tasks."""

    def own(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library, which keeps what it keeps
            pass

    return own


def map_batches(df: DataFrame, columns: list[str], make: Callable[[], Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None]], schema) -> DataFrame:
    """mapInArrow of a function that is made once per task and gets at most ROWS rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                out = work(batch.slice(lo, ROWS))
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                elif out is not None:
                    yield out

    return df.select(*columns).mapInArrow(tidy(run), schema)


def ascii_lower(column):
    """Lower-cases A-Z alone; F.lower would change other letters too."""
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)
