"""Trades from JSON lines, from rows and from a formula.

The order of arrival is ``seq``.  JSON lines may carry it, on all of their lines or on none; without it
a trade is numbered by its file, in the order of paths, and its line.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import BOOK, SEQUENCED, TRADE

BASE = 1_700_000_000_000_000_000


def _good() -> F.Column:
    good = F.col("side").isin("buy", "sell")
    for f in TRADE.fields:
        good = good & F.col(f.name).isNotNull()
    return F.coalesce(good, F.lit(False))


def validated(trades: DataFrame, reject: bool = True) -> DataFrame:
    """Trades whose fields are all there and whose side is buy or sell; others raise, or go if not ``reject``."""
    if not reject:
        return trades.filter(_good())
    fail = F.raise_error(F.concat(F.lit("not a trade: "), F.to_json(F.struct(*TRADE.names)))).cast("string")
    return trades.withColumn("side", F.when(_good(), F.col("side")).otherwise(fail))


#: Lines of one file are numbered below this, files above it.
FILE_SHIFT = 40
_CORRUPT = "_corrupt_record"
_PARSED = T.StructType([*SEQUENCED.fields, T.StructField(_CORRUPT, T.StringType())])


def _parsed(lines: DataFrame, number: F.Column) -> DataFrame:
    """Rows of ``lines`` (value) as trades; what is no trade is text in ``_corrupt_record``, else that is null."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    rows = lines.select("value", number.alias("_number")).filter(F.trim("value") != "").select("value", "_number", F.from_json("value", _PARSED, options).alias("r"))
    rows = rows.select("value", "_number", "r.*")
    bad = F.col(_CORRUPT).isNotNull() | ~_good()
    return rows.select(*TRADE.names, F.coalesce("seq", "_number").alias("seq"), *BOOK, F.when(bad, F.col("value")).alias(_CORRUPT))


def read_trades(spark: SparkSession, path: str, dead_letters: bool = False) -> DataFrame:
    """Trades of JSON lines with ``seq``; blank lines are skipped.  A bad row raises; with ``dead_letters``
    it is kept as text in ``_corrupt_record`` instead.

    A line's number is where its block begins in the file plus the line's place in the block, so that no
    pass over the data is needed to number it; files are numbered in the order of their paths."""
    lines = spark.read.text(path)
    files = sorted(lines.inputFiles())
    if not files:
        return spark.createDataFrame([], T.StructType([*SEQUENCED.fields, *([T.StructField(_CORRUPT, T.StringType())] if dead_letters else [])]))
    order = spark.createDataFrame(list(enumerate(files)), "_file long, _path string")
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = lines.select("value", F.input_file_name().alias("_path"), place.alias("_place"))
    # the list of files is small next to the lines; Spark broadcasts it only below its own threshold
    numbered = numbered.join(order, "_path")
    rows = _parsed(numbered, F.col("_file") * F.lit(1 << FILE_SHIFT) + F.col("_place"))
    if dead_letters:
        return rows
    fail = F.raise_error(F.concat(F.lit("not a trade: "), F.col(_CORRUPT))).cast("string")
    return rows.withColumn("side", F.when(F.col(_CORRUPT).isNull(), F.col("side")).otherwise(fail)).drop(_CORRUPT)


def _stream(spark: SparkSession, path: str, max_files: int, number_lines: bool) -> DataFrame:
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    if not number_lines:
        return _parsed(reader.text(path), F.lit(None).cast("long"))
    files = reader.option("wholetext", True).text(path).select("value", F.unix_millis("_metadata.file_modification_time").alias("_ms"))
    lines = files.select("_ms", F.posexplode(F.split("value", "\n")).alias("_line", "value"))
    return _parsed(lines, F.col("_ms") * F.lit(1 << 22) + F.col("_line"))


def stream_trades(spark: SparkSession, path: str, max_files: int = 64, number_lines: bool = False) -> DataFrame:
    """Trades of JSON-lines files as they come; ``max_files`` a trigger bounds what is in flight.

    Lines that are no trades are passed over and do not end the stream, see ``stream_dead_letters``.
    ``number_lines`` is for files without ``seq``: trades are numbered by the time at which their file was
    written, in milliseconds, and their line, of four million at most; a file is then read as one row."""
    return _stream(spark, path, max_files, number_lines).filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT)


def stream_dead_letters(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """value: the lines of the files that ``stream_trades`` passes over."""
    return _stream(spark, path, max_files, False).filter(F.col(_CORRUPT).isNotNull()).select(F.col(_CORRUPT).alias("value"))


def trades_from_rows(spark: SparkSession, rows: Iterable[tuple | dict]) -> DataFrame:
    """Trades (ts, symbol, price, qty, side) in the order given, which becomes ``seq``."""
    rows = [tuple(r[c] for c in TRADE.names) if isinstance(r, dict) else tuple(r) for r in rows]
    schema = T.StructType([*TRADE.fields, T.StructField("seq", T.LongType(), False)])
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


def _formula(i: F.Column) -> list[F.Column]:
    return [
        (F.lit(BASE) + i * 100_000_000).alias("ts"), F.lit("BTCUSDT").alias("symbol"), (F.lit(30000.0) + (i % 500) * 0.1).alias("price"),
        (F.lit(0.1) + (i % 10) * 0.05).alias("qty"), F.when(i % 2 == 0, "buy").otherwise("sell").alias("side"), i.alias("seq"),
    ]


def synthetic_trades(spark: SparkSession, n: int) -> DataFrame:
    """n trades, ten a second, with prices, quantities and sides in cycles."""
    return spark.range(n).select(*_formula(F.col("id")))


def synthetic_stream(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    """The same trades as a stream."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(*_formula(F.col("value")))
