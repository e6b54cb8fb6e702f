"""Point lookups: a cache of bounded size and age, then the stored partitions."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import FeatureQueries
from .schemas import FEATURE
from .sources import scan_features


class FeatureStore:
    """Serves feature rows of ``base``.

    The cache is a dictionary of the newest days' rows, at most ``most_rows`` of them, loaded anew once
    it is older than ``ttl_s``; a failed load keeps the old one.  What it has not, the store looks up in
    the one partition that can have it.
    """

    def __init__(self, spark: SparkSession, base: str, ttl_s: float = 60.0, most_rows: int = 1_000_000) -> None:
        self.spark, self.base, self.ttl_s, self.most_rows = spark, base, ttl_s, most_rows
        self.cache: dict[tuple[str, int], dict] = {}
        self.loaded_at: float | None = None

    def refresh(self) -> int:
        """Loads the cache; the number of rows in it."""
        cache: dict[tuple[str, int], dict] = {}
        for r in self._hot().toLocalIterator():
            old = cache.get((r["symbol"], r["ts"]))
            if old is None or old["trade_count_1m"] < r["trade_count_1m"]:  # of one instant, the last trade's row
                cache[r["symbol"], r["ts"]] = r.asDict()
        self.cache = cache
        self.loaded_at = time.monotonic()
        return len(self.cache)

    def _hot(self) -> DataFrame:
        rows = scan_features(self.spark, self.base)
        counts = sorted(rows.groupBy("date").count().collect(), reverse=True)
        days, used = [], 0
        for date, n in counts:
            if used + n > self.most_rows:
                break
            days.append(date)
            used += n
        return rows.filter(F.col("date").isin(days)).select(*FEATURE.names)

    def _fresh(self) -> None:
        if self.loaded_at is None or time.monotonic() - self.loaded_at > self.ttl_s:
            try:
                self.refresh()
            except Exception:  # noqa: BLE001  stale rows are better than none
                self.loaded_at = time.monotonic() if self.loaded_at is not None else None

    def lookup(self, symbol: str, ts: int) -> dict | None:
        """The row with its ``source``, "cache" or "parquet"; None if there is none."""
        self._fresh()
        hit = self.cache.get((symbol, ts))
        if hit is not None:
            return {**hit, "source": "cache"}
        found = FeatureQueries(self.spark, self.base).q4_point_lookup(symbol, ts).collect()
        return {**found[0].asDict(), "source": "parquet"} if found else None

    def health(self) -> dict:
        age = float("inf") if self.loaded_at is None else time.monotonic() - self.loaded_at
        return {"status": "ok", "cache_rows": len(self.cache), "cache_age_s": age}
