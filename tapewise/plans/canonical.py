"""The five canonical queries over feature rows, as DataFrames and as SQL text with bound parameters.

A cutoff is an instant in nanoseconds.  Stored rows are partitioned by day, which Catalyst does not
infer from ``ts``; the queries add the day themselves, so that older partitions are not opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import minute
from ..schemas import DAY, FEATURE, HOUR, MINUTE
from ..sources import scan_features, scan_hour

SQL = {
    "q1": f"""SELECT ts - pmod(ts, {MINUTE}) AS minute_ts, sum(vwap_1m * trade_count_1m) / nullif(sum(trade_count_1m), 0) AS vwap
FROM features WHERE symbol = :symbol AND ts >= :cutoff AND date >= :cutoff div {DAY} GROUP BY 1 ORDER BY 1""",
    "q2": f"""SELECT symbol, sum(trade_count_1m) AS total_trades, avg(vwap_1m) AS avg_vwap
FROM features WHERE ts >= :cutoff AND date >= :cutoff div {DAY} GROUP BY symbol ORDER BY total_trades DESC, symbol LIMIT 10""",
    "q3": f"""SELECT symbol, min(rv_1m) AS rv_min, avg(rv_1m) AS rv_avg, max(rv_1m) AS rv_max, count(*) AS n
FROM features WHERE ts >= :cutoff AND date >= :cutoff div {DAY} GROUP BY symbol ORDER BY rv_avg DESC, symbol""",
    "q4": f"""SELECT {", ".join(FEATURE.names)} FROM features
WHERE symbol = :symbol AND ts = :ts AND date = :ts div {DAY} AND hour = (:ts % {DAY}) div {HOUR} ORDER BY trade_count_1m DESC LIMIT 1""",
    "q5": f"""SELECT ts - pmod(ts, {MINUTE}) AS minute_ts, sum(ofi_1m) AS cumulative_ofi, count(*) AS n_trades
FROM features WHERE symbol = :symbol AND ts >= :cutoff AND date >= :cutoff div {DAY} GROUP BY 1 ORDER BY 1""",
}


class FeatureQueries:
    """Queries over stored feature rows, or over a DataFrame of them."""

    def __init__(self, spark: SparkSession, source: str | DataFrame) -> None:
        self.spark, self.base = spark, source if isinstance(source, str) else None
        if isinstance(source, str):
            self.rows = scan_features(spark, source)
        else:
            from ..functions import day, hour

            self.rows = source.withColumn("date", day(F.col("ts"))).withColumn("hour", hour(F.col("ts")))

    def _since(self, cutoff: int, symbol: str | None = None) -> DataFrame:
        rows = self.rows.filter((F.col("ts") >= cutoff) & (F.col("date") >= cutoff // DAY))
        return rows if symbol is None else rows.filter(F.col("symbol") == symbol)

    def q1_vwap_per_minute(self, symbol: str, cutoff: int) -> DataFrame:
        """minute_ts, vwap: average price by minute, weighted by counts."""
        weight = F.col("trade_count_1m")
        out = self._since(cutoff, symbol).groupBy(minute(F.col("ts")).alias("minute_ts"))
        return out.agg((F.sum(F.col("vwap_1m") * weight) / F.nullif(F.sum(weight), F.lit(0))).alias("vwap")).orderBy("minute_ts")

    def q2_top_symbols(self, cutoff: int, k: int = 10) -> DataFrame:
        """symbol, total_trades, avg_vwap of the k busiest symbols."""
        out = self._since(cutoff).groupBy("symbol").agg(F.sum("trade_count_1m").alias("total_trades"), F.avg("vwap_1m").alias("avg_vwap"))
        return out.orderBy(F.desc("total_trades"), "symbol").limit(k)

    def q3_rv_distribution(self, cutoff: int) -> DataFrame:
        """symbol, rv_min, rv_avg, rv_max, n."""
        rv = F.col("rv_1m")
        out = self._since(cutoff).groupBy("symbol").agg(F.min(rv).alias("rv_min"), F.avg(rv).alias("rv_avg"), F.max(rv).alias("rv_max"), F.count("*").alias("n"))
        return out.orderBy(F.desc("rv_avg"), "symbol")

    def q4_point_lookup(self, symbol: str, ts: int) -> DataFrame:
        """The feature row of a symbol at an instant, or none; of several, that of the last trade.

        Stored rows are looked up in their one folder."""
        here = (F.col("symbol") == symbol) & (F.col("ts") == ts) & (F.col("date") == ts // DAY) & (F.col("hour") == ts % DAY // HOUR)
        rows = scan_hour(self.spark, self.base, symbol, ts) if self.base else self.rows
        if rows is None:
            return self.spark.createDataFrame([], FEATURE)
        return rows.filter(here).select(*FEATURE.names).orderBy(F.desc("trade_count_1m")).limit(1)

    def q5_ofi_momentum(self, symbol: str, cutoff: int) -> DataFrame:
        """minute_ts, cumulative_ofi, n_trades."""
        out = self._since(cutoff, symbol).groupBy(minute(F.col("ts")).alias("minute_ts"))
        return out.agg(F.sum("ofi_1m").alias("cumulative_ofi"), F.count("*").alias("n_trades")).orderBy("minute_ts")

    def sql(self, text: str, **parameters: object) -> DataFrame:
        """Any SQL over the view ``features``; parameters are bound, never pasted in."""
        self.rows.createOrReplaceTempView("features")
        return self.spark.sql(text, args=parameters)

    def canonical(self, name: str, **parameters: object) -> DataFrame:
        return self.sql(SQL[name], **parameters)
