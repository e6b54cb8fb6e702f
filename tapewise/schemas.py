"""Schemas and constants of the trade-feature engine.  All instants and spans are nanoseconds."""

from __future__ import annotations

from pyspark.sql import types as T

SECOND = 1_000_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND
LATENESS = 2 * SECOND

#: Default windows: three for the average price, two for volatility, one for flow and count.
VWAP_WINDOWS = {"vwap_1m": MINUTE, "vwap_5m": 5 * MINUTE, "vwap_15m": 15 * MINUTE}
RV_WINDOWS = {"rv_1m": MINUTE, "rv_5m": 5 * MINUTE}

BOOK = ("bid_price", "bid_qty", "ask_price", "ask_qty")


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


TRADE = _struct(("ts", T.LongType(), False), ("symbol", T.StringType(), False), ("price", T.DoubleType(), False), ("qty", T.DoubleType(), False), ("side", T.StringType(), False))
#: A trade as the engine takes it: arrival order, and the best bid and ask where they are known.
SEQUENCED = T.StructType([*TRADE.fields, T.StructField("seq", T.LongType(), False), *[T.StructField(c, T.DoubleType(), True) for c in BOOK]])
FEATURE = _struct(
    ("ts", T.LongType(), False), ("symbol", T.StringType(), False), ("vwap_1m", T.DoubleType(), True), ("vwap_5m", T.DoubleType(), True), ("vwap_15m", T.DoubleType(), True),
    ("rv_1m", T.DoubleType(), False), ("rv_5m", T.DoubleType(), False), ("ofi_1m", T.DoubleType(), False), ("microprice", T.DoubleType(), True), ("trade_count_1m", T.LongType(), False),
)
STORED = T.StructType([*FEATURE.fields, T.StructField("date", T.IntegerType()), T.StructField("hour", T.IntegerType())])
