"""Tables, checkpoints and hold-outs shared by the operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/tapewise-checkpoints"
    return folder


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_made: list[str] = []


def store(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, lost executors lose nothing."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Removes what ``store`` wrote for ``df``, once nothing reads it any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles() if "/stored-" in name}:
        _remove(df.sparkSession, folder)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """Stores what ``make`` returns, and removes all that was stored on the way there."""
    before = len(_made)
    out = store(make())
    for folder in _made[before:-1]:
        _remove(out.sparkSession, folder)
    del _made[before:-1]
    return out


#: Arrow batches to Python workers are cut at so many bytes, whatever the size of rows.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lets Spark cut Arrow batches by bytes too; a limit that the session has set stays, if it is lower."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    digits = (now or "").rstrip("bB")
    if not digits.isdigit() or int(digits) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Gives back to the system what Arrow and the allocator keep: idle workers hold on to it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(run: Callable[[Iterable[Any]], Iterator[Any]]) -> Callable[[Iterable[Any]], Iterator[Any]]:
    """A function over a task's batches that gives memory back at its end."""

    def wrapped(batches: Iterable[Any]) -> Iterator[Any]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
