"""Late trades: those more than the lateness behind the newest that arrived before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrival_number
from ..schemas import LATENESS

#: Trades of a symbol are looked at in runs of this many arrival numbers, so that one busy symbol is many tasks.
RUN = 1 << 18


def _marked(trades: DataFrame, lateness: int) -> DataFrame:
    """trades with ``late``.  The watermark is the symbol's newest instant so far, 0 at first."""
    runs = trades.withColumn("seq", arrival_number(F.col("seq"))).withColumn("_run", F.floor(F.col("seq") / RUN))
    newest = runs.groupBy("symbol", "_run").agg(F.max("ts").alias("_max"))
    earlier = Window.partitionBy("symbol").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    newest = newest.select("symbol", "_run", F.max("_max").over(earlier).alias("_before"))
    within = Window.partitionBy("symbol", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    marked = runs.withColumn("_own", F.max("ts").over(within)).join(newest, ["symbol", "_run"])
    mark = F.greatest(F.coalesce("_own", F.lit(0)), F.coalesce("_before", F.lit(0)), F.lit(0))
    return marked.withColumn("late", F.col("ts") < mark - lateness).select(*trades.columns, "late")


def drop_late(trades: DataFrame, lateness: int = LATENESS) -> DataFrame:
    """Trades that are not late; a trade exactly ``lateness`` behind stays.  Late trades never raise the mark."""
    return _marked(trades, lateness).filter(~F.col("late")).drop("late")


def late_totals(trades: DataFrame, lateness: int = LATENESS) -> DataFrame:
    """symbol, late_drop_total, and a row with a null symbol for all of them."""
    counts = _marked(trades, lateness).groupBy("symbol").agg(F.count_if("late").alias("late_drop_total"))
    return counts.unionByName(counts.agg(F.lit(None).cast("string").alias("symbol"), F.coalesce(F.sum("late_drop_total"), F.lit(0).cast("long")).alias("late_drop_total")))
