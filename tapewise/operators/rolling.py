"""Rolling features in event time.

A window of a trade is all of its symbol's trades from ``span`` before it (included) up to itself in
the order of (ts, seq).  A sliding frame would be added up anew for each row; here every window is the
difference of two growing frames,

* rows up to this one, by (ts, seq), which settles ties (or, with ``peers``, all rows up to this instant), and
* rows strictly before ts - span, by ts,

each of which Spark extends row by row, with one shuffle and one sort for all features.  For volatility
the second frame sums each row's *next* squared return, so that the first row of a window, whose
predecessor is outside, adds nothing.  Symbols are cut into stretches of time that overlap by the
longest window: a busy symbol is many tasks, and sums start anew, which bounds their rounding error;
prices are taken relative to a stretch's first for the same reason.  What a double is above whole
steps of 2^-20 is added up apart from them: sums of steps are exact below 2^33, so that their
difference leaves no residue of the trades before the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrival_number, microprice, signed_qty, squared_return
from ..schemas import BOOK, DAY, MINUTE, RV_WINDOWS, VWAP_WINDOWS


STEP, EXACT = 2.0**-20, 2.0**33


def _halves(x: Column) -> tuple[Column, Column]:
    """``x`` as whole steps and the rest; x itself and 0 where a sum of steps would not be exact."""
    steps = F.rint(x / STEP) * STEP
    fits = F.abs(x) < EXACT
    return F.when(fits, steps).otherwise(x), F.when(fits, x - steps).otherwise(0.0)


def rolling_features(trades: DataFrame, vwap: dict[str, int] | None = None, rv: dict[str, int] | None = None, ofi: tuple[str, int] = ("ofi_1m", MINUTE), count: tuple[str, int] = ("trade_count_1m", MINUTE), stretch: int = DAY, keep: tuple[str, ...] = (), same_ts_returns: bool = True, peers: bool = False) -> DataFrame:
    """ts, symbol, average prices, volatilities, flow, microprice and count of each trade.

    The average price is null where the window's quantities are all 0.  With ``same_ts_returns`` off,
    trades of one instant have no return between them.  With ``peers`` a window ends with its trade's
    instant and holds all trades of it, as SQL's RANGE frames do.  ``keep`` names further columns to pass on.
    """
    vwap, rv = VWAP_WINDOWS if vwap is None else vwap, RV_WINDOWS if rv is None else rv
    halo = max([*vwap.values(), *rv.values(), ofi[1], count[1]])
    stretch = max(stretch, 4 * halo)
    part = F.floor(F.col("ts") / stretch)
    # a trade also serves the next stretch's windows if it is near its end
    trades = trades.withColumn("seq", arrival_number(F.col("seq")))
    trades = trades.withColumn("_part", F.explode(F.when(F.pmod("ts", F.lit(stretch)) >= stretch - halo, F.array(part, part + 1)).otherwise(F.array(part))))
    by = Window.partitionBy("symbol", "_part")
    order = by.orderBy("ts", "seq")
    rows_upto = order.rowsBetween(Window.unboundedPreceding, 0)
    upto = by.orderBy("ts").rangeBetween(Window.unboundedPreceding, 0) if peers else rows_upto
    before = lambda span: by.orderBy("ts").rangeBetween(Window.unboundedPreceding, -(span + 1))

    r2 = squared_return(F.col("price"), F.lag("price").over(order))
    if not same_ts_returns:
        r2 = F.when(F.col("ts") == F.lag("ts").over(order), 0.0).otherwise(r2)
    rows = trades.withColumn("_p0", F.first("price").over(rows_upto)).withColumn("_r2", r2)
    rows = rows.withColumn("_next_r2", F.coalesce(F.lead("_r2").over(order), F.lit(0.0)))
    rows = rows.withColumn("_pq", (F.col("price") - F.col("_p0")) * F.col("qty")).withColumn("_flow", signed_qty(F.col("qty"), F.col("side")))

    def window_sum(value: Column, span: int, start: Column | None = None) -> Column:
        return F.sum(value).over(upto) - F.coalesce(F.sum(value if start is None else start).over(before(span)), F.lit(0))

    def exact_sum(value: str, span: int, start: str | None = None) -> Column:
        steps, rest = (window_sum(v, span, s) for v, s in zip(_halves(F.col(value)), _halves(F.col(start or value))))
        return steps + rest

    some = F.when(F.col("qty") != 0, 1).otherwise(0)
    out = {}
    for name, span in vwap.items():
        moved = exact_sum("_pq", span) / F.nullif(exact_sum("qty", span), F.lit(0.0))
        # exact: whether any quantity is not 0; a difference of sums may leave a residue
        out[name] = F.when(window_sum(some, span) > 0, F.col("_p0") + moved)
    for name, span in rv.items():
        out[name] = F.greatest(exact_sum("_r2", span, "_next_r2"), F.lit(0.0))
    out[ofi[0]] = exact_sum("_flow", ofi[1])
    out["microprice"] = microprice(*(F.col(c) for c in BOOK)) if all(c in trades.columns for c in BOOK) else F.lit(None).cast("double")
    out[count[0]] = window_sum(F.lit(1), count[1]).cast("long")
    mine = F.col("_part") == F.floor(F.col("ts") / stretch)
    return rows.select("ts", "symbol", *keep, "_part", *(c.alias(n) for n, c in out.items())).filter(mine).drop("_part")
