"""Micro-batches: numbers for rows at rest, triggers and admission limits for streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MAX_ROWS, MAX_LATENCY_MS = 1000, 100


def batch_numbers(trades: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """trades with ``batch``: arrival order cut into runs of ``max_rows``.

    Ranks are made of ranks within stretches of seq and the stretches' sums, so no task has all rows."""
    stretch = 1 << 16
    rows = trades.withColumn("_s", F.floor(F.col("seq") / stretch))
    sums = rows.groupBy("_s").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_s", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_s").orderBy("seq")) - 1
    return rows.withColumn("_r", within).join(sums, "_s").withColumn("batch", F.floor((F.col("_r") + F.col("_before")) / max_rows)).drop("_s", "_r", "_before")


def micro_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, max_latency_ms: int = MAX_LATENCY_MS, drain: bool = False) -> StreamingQuery:
    """Hands every micro-batch to ``handle``; with ``drain``, until the source has no more, else at least
    every ``max_latency_ms``.  The source's own limits bound a batch; a failed query resumes from its checkpoint."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=f"{max_latency_ms} milliseconds")).start()
