"""Per-trade features as a stateful operator.

Structured Streaming's own watermark is global and moves between micro-batches; here each symbol has its
own, which every trade may move.  State is what ``SymbolState`` keeps: 15 minutes and 2 seconds of
trades, the watermark and the count of late trades.  Checkpoints give exactly-once state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.arrival import SymbolState, replay
from ..schemas import FEATURE

STATE = T.StructType([T.StructField("ts", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("qty", T.DoubleType()), T.StructField("flow", T.DoubleType())])
MARK = T.StructType([T.StructField("watermark", T.LongType()), T.StructField("late", T.LongType())])
OUT = T.StructType([*FEATURE.fields, T.StructField("late_drop_total", T.LongType(), False)])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FeatureProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.trades = handle.getListState("trades", STATE)
        self.mark = handle.getValueState("mark", MARK)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state, kept = SymbolState(), list(self.trades.get())
        if kept:
            ts, *rest = zip(*kept)
            state.trades = [np.array(ts, np.int64), *(np.array(x, np.float64) for x in rest)]
        if self.mark.exists():
            mark, late = self.mark.get()
            state.watermark, state.late = int(mark), int(late)
        # a micro-batch's rows may come in pieces; arrival order is that of seq over all of them
        out = replay(state, key[0], pd.concat(list(rows), ignore_index=True))
        self.trades.put(list(zip(*(x.tolist() for x in state.trades)))) if len(state.trades[0]) else self.trades.clear()
        self.mark.update((state.watermark, state.late))
        yield out.assign(late_drop_total=state.late)[OUT.names]

    def close(self) -> None:
        pass


def to_features(trades: DataFrame) -> DataFrame:
    """A stream of trades (with seq) to a stream of feature rows and the symbol's late count so far."""
    trades.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return trades.groupBy("symbol").transformWithStateInPandas(FeatureProcessor(), outputStructType=OUT, outputMode="Append", timeMode="None")


def stream_features(trades: DataFrame, out: str, checkpoint: str, drain: bool = True):
    """Writes feature rows of a stream of trades as Parquet under ``out``."""
    writer = to_features(trades).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime="100 milliseconds")).start()
