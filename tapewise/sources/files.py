"""Feature rows as Parquet, partitioned by symbol, day since the epoch and hour of the day."""

from __future__ import annotations

import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import day, hour
from ..schemas import DAY, FEATURE, HOUR, STORED

KEYS = ("symbol", "date", "hour")
#: Spark reads the folders of an empty symbol and of one named like Hive's null as null: the folder names
#: of these symbols, and of those that begin with the mark, have it before them.
_NULL, _MARK = "__HIVE_DEFAULT_PARTITION__", "\x01"


def _folder(symbol: str) -> str:
    return _MARK + symbol if symbol in ("", _NULL) or symbol.startswith(_MARK) else symbol


def _symbols(stored: DataFrame) -> DataFrame:
    """Stored rows with the symbols that their folders stand for."""
    s = F.col("symbol")
    return stored.select(*(F.when(s.startswith(_MARK), F.substring(s, 2, 2**31 - 1)).otherwise(s).alias("symbol") if c == "symbol" else F.col(c) for c in stored.columns))


def write_features(features: DataFrame, base: str, overwrite: bool = False, row_group: int = 128 << 20, page: int = 1 << 20) -> None:
    """Appends feature rows; ``overwrite`` replaces the partitions that the rows fall into, so that a
    rerun leaves each row once.  Rows of a partition meet before the write: one file for each."""
    s = F.col("symbol")
    rows = features.select(*FEATURE.names).withColumn("date", day(F.col("ts"))).withColumn("hour", hour(F.col("ts")))
    rows = rows.withColumn("symbol", F.when(s.isin("", _NULL) | s.startswith(_MARK), F.concat(F.lit(_MARK), s)).otherwise(s))
    writer = rows.repartition(*KEYS).write.partitionBy(*KEYS).option("compression", "snappy").option("parquet.block.size", row_group).option("parquet.page.size", page).option("parquet.enable.dictionary", "true")
    (writer.mode("overwrite").option("partitionOverwriteMode", "dynamic") if overwrite else writer.mode("append")).parquet(base)


def scan_features(spark: SparkSession, base: str) -> DataFrame:
    """All feature rows with ``date`` and ``hour``, unread until needed.  The schema is given, so that a
    symbol of digits stays text; files may have ``symbol`` in their path only or also inside."""
    return _symbols(spark.read.schema(STORED).parquet(base))


def read_features(spark: SparkSession, base: str, symbol: str | None = None, date_from: int | None = None, date_to: int | None = None) -> DataFrame:
    """Feature rows of a symbol and of days, both ends included; other partitions are not opened."""
    rows = scan_features(spark, base)
    for wanted in ((F.col("symbol") == symbol) if symbol is not None else None, (F.col("date") >= date_from) if date_from is not None else None, (F.col("date") <= date_to) if date_to is not None else None):
        rows = rows if wanted is None else rows.filter(wanted)
    return rows.select(*FEATURE.names)


def scan_hour(spark: SparkSession, base: str, symbol: str, ts: int) -> DataFrame | None:
    """Feature rows of the one folder that can hold a symbol's instant, or None: nothing else is listed."""
    jvm = spark._jvm
    escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(_folder(symbol))
    folder = f"{base.rstrip('/')}/symbol={escaped}/date={ts // DAY}/hour={ts % DAY // HOUR}"
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return _symbols(spark.read.schema(STORED).option("basePath", base).parquet(folder))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/tapewise-checkpoints"
    return folder


def files_state(spark: SparkSession, path: str) -> frozenset[tuple[str, int, int]]:
    """Name, length and time of change of each file below ``path``."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True)
    state = set()
    while files.hasNext():
        f = files.next()
        state.add((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return frozenset(state)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One Parquet file."""
    return spark.read.parquet(path)


def measure_write(features: DataFrame, base: str) -> dict[str, float]:
    """Writes and reports wall_s, bytes_written, rows_written, rows_per_sec, mb_per_sec."""
    spark = features.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    size = lambda: system.getContentSummary(path).getLength() if system.exists(path) else 0
    before, rows, began = size(), features.count(), time.perf_counter()
    write_features(features, base)
    wall = time.perf_counter() - began
    written = size() - before
    return {"wall_s": wall, "bytes_written": written, "rows_written": rows, "rows_per_sec": rows / wall, "mb_per_sec": written / 1e6 / wall}
