"""Replay in arrival order: what a stream emits for each trade, given only what has arrived.

Once trades are out of order no single frame expresses this: a window holds trades that have arrived
(by seq) and are not older than the span (by ts).  Accepted trades are never more than the lateness
behind the newest, so in order of arrival a window is a run up to the trade itself, from the first place
after which no accepted trade is too old, and a few trades shortly before that place.  Runs are
differences of growing sums; the few are looked at one by one, all of them at once in arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..schemas import BOOK, FEATURE, HOUR, LATENESS, MINUTE, RV_WINDOWS, VWAP_WINDOWS
from .late import drop_late

KEPT = 15 * MINUTE + LATENESS
STRETCH = HOUR
_AT_ONCE = 1 << 20
_ARROW = to_arrow_schema(FEATURE)


def _growing(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, x.dtype), np.cumsum(x)))


class Arrived:
    """Accepted trades of one symbol in order of arrival."""

    def __init__(self, ts: np.ndarray, price: np.ndarray, qty: np.ndarray, flow: np.ndarray) -> None:
        self.ts, self.price, self.base = ts, price, price[0] if len(price) else 0.0
        self.newest = np.maximum.accumulate(ts) if len(ts) else ts
        self.oldest_after = np.minimum.accumulate(ts[::-1])[::-1] if len(ts) else ts
        self.values = {"pq": (price - self.base) * qty, "q": qty, "flow": flow, "n": np.ones(len(ts), np.int64), "some": (qty != 0).astype(np.int64)}
        self.sums = {name: _growing(x) for name, x in self.values.items()}
        self.returns = _growing(np.concatenate((np.zeros(1), self.squared(np.arange(len(ts) - 1), np.arange(1, len(ts)))))) if len(ts) else np.zeros(1)

    def squared(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Squared logarithmic returns between places; 0 without two positive prices."""
        a, b = self.price[before], self.price[after]
        fine = (a > 0) & (b > 0)
        return np.where(fine, np.log(np.where(fine, b, 1.0) / np.where(fine, a, 1.0)) ** 2, 0.0)

    def window(self, i: np.ndarray, span: int) -> dict[str, np.ndarray]:
        """Sums over the windows of the trades at places i, and of their squared returns."""
        low = self.ts[i] - span
        start, run = np.searchsorted(self.newest, low), np.searchsorted(self.oldest_after, low)
        out = {name: sums[i + 1] - sums[run] for name, sums in self.sums.items()}
        out["rv"] = self.returns[i + 1] - self.returns[run + 1]
        many = run - start
        odd = np.flatnonzero(many > 0)
        edges = np.cumsum(many[odd])
        for part in np.split(odd, np.searchsorted(edges, np.arange(_AT_ONCE, edges[-1], _AT_ONCE))) if len(odd) else []:
            n = many[part]
            owner = np.repeat(part, n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[owner]
            inside = self.ts[at] >= low[owner]
            at, owner = at[inside], owner[inside]
            for name, x in self.values.items():
                out[name] += np.bincount(owner, x[at], len(i)).astype(x.dtype)
            last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
            out["rv"] += np.bincount(owner, self.squared(at, np.where(last, run[owner], np.append(at[1:], 0))), len(i)) if len(at) else 0
        return out

    def features(self, i: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
        """Feature columns of the trades at places i, but for symbol and microprice."""
        out: dict = {"ts": self.ts[i]}
        windows = {span: self.window(i, span) for span in {*VWAP_WINDOWS.values(), *RV_WINDOWS.values()}}
        for name, span in VWAP_WINDOWS.items():
            w = windows[span]
            none = w["some"] == 0
            # a quantity's residue does not count: whether any is not 0 is counted exactly
            out[name] = pa.array(self.base + w["pq"] / np.where(none | (w["q"] == 0), 1.0, w["q"]), pa.float64(), mask=none)
        for name, span in RV_WINDOWS.items():
            out[name] = np.maximum(windows[span]["rv"], 0.0)
        out["ofi_1m"], out["trade_count_1m"] = windows[MINUTE]["flow"], windows[MINUTE]["n"]
        return out


def _microprice(columns: dict[str, np.ndarray] | None, n: int) -> pa.Array:
    if columns is None:
        return pa.nulls(n, pa.float64())
    bp, bq, ap, aq = (columns[c] for c in BOOK)
    total = bq + aq
    none = np.isnan(bp) | np.isnan(ap) | np.isnan(total) | (total == 0)
    return pa.array((ap * bq + bp * aq) / np.where(none, 1.0, total), pa.float64(), mask=none)


def _table(symbol: str, got: dict, micro: pa.Array) -> pa.Table:
    columns = {**got, "symbol": pa.array([symbol] * len(micro), pa.string()), "microprice": micro}
    return pa.Table.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in _ARROW], schema=_ARROW)


def arrival_features(trades: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Feature rows as a stream emits them; late trades have none.

    Late trades are found first (``drop_late``).  A window reaches back 15 minutes and, among trades that
    arrived before, ahead by the lateness, so a symbol is cut into stretches of time with these margins:
    a busy symbol is many tasks, each of which sorts its trades by arrival."""
    halo = max(VWAP_WINDOWS.values())
    stretch = max(stretch, 4 * halo)
    books = all(c in trades.columns for c in BOOK)
    part, inside = F.floor(F.col("ts") / stretch), F.pmod("ts", F.lit(stretch))
    near = F.when(inside >= stretch - halo, F.array(part, part + 1)).when(inside <= LATENESS, F.array(part - 1, part)).otherwise(F.array(part))
    rows = drop_late(trades).select("symbol", "seq", "ts", "price", "qty", (F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))).alias("flow"), *(BOOK if books else ()), F.explode(near).alias("part"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        column = lambda c: table.column(c).to_numpy()
        ts = column("ts")
        own = np.flatnonzero(ts // stretch == key[1].as_py())
        got = Arrived(ts, column("price"), column("qty"), column("flow")).features(own)
        book = {c: table.column(c).cast(pa.float64()).to_pandas().to_numpy()[own] for c in BOOK} if books else None
        return _table(key[0].as_py(), got, _microprice(book, len(own)))

    return rows.groupBy("symbol", "part").applyInArrow(run, FEATURE)


@dataclass
class SymbolState:
    """What a stream keeps of a symbol: accepted trades (ts, price, qty, flow) of the last 15 minutes and
    2 seconds in arrival order, the watermark, the late count."""

    trades: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, np.int64), *(np.zeros(0) for _ in range(3))])
    watermark: int = 0
    late: int = 0


def replay(state: SymbolState, symbol: str, rows: pd.DataFrame) -> pd.DataFrame:
    """Feature rows of more trades of a symbol, which are put into arrival order first; the state moves on."""
    rows = rows.sort_values("seq", kind="stable")
    if rows["seq"].isna().any():
        raise ValueError("a trade has no seq: its order of arrival is unknown")
    ts = rows["ts"].to_numpy(np.int64)
    marks = np.maximum.accumulate(np.concatenate(([state.watermark], ts)))
    fine = ts >= marks[:-1] - LATENESS
    rows, ts = rows[fine], ts[fine]
    qty = rows["qty"].to_numpy(np.float64)
    new = ts, rows["price"].to_numpy(np.float64), qty, np.where(rows["side"] == "buy", qty, -qty)
    old = len(state.trades[0])
    every = [np.concatenate(x) for x in zip(state.trades, new)]
    got = Arrived(*every).features(np.arange(old, old + len(ts)))
    book = {c: rows[c].to_numpy(np.float64) for c in BOOK} if all(c in rows.columns for c in BOOK) else None
    state.watermark, state.late = int(marks[-1]), state.late + int((~fine).sum())
    keep = every[0] >= state.watermark - KEPT
    state.trades = [x[keep] for x in every]
    return _table(symbol, got, _microprice(book, len(ts))).to_pandas()
