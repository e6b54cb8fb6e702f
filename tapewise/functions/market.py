"""Expressions over trades: all of them stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DAY, HOUR, MINUTE


def arrival_number(seq: Column) -> Column:
    """The trade's arrival number; one that has none is an error, as its order is unknown."""
    return F.coalesce(seq, F.raise_error(F.lit("a trade has no seq: its order of arrival is unknown")).cast("long"))


def signed_qty(qty: Column, side: Column) -> Column:
    """Quantity, negative unless bought."""
    return F.when(side == "buy", qty).otherwise(-qty)


def squared_return(price: Column, before: Column) -> Column:
    """Squared logarithmic return; 0 without two positive prices."""
    r = F.ln(F.when((price > 0) & (before > 0), price / F.nullif(before, F.lit(0.0))))
    return F.coalesce(r * r, F.lit(0.0))


def microprice(bid_price: Column, bid_qty: Column, ask_price: Column, ask_qty: Column) -> Column:
    """(ask * bid quantity + bid * ask quantity) / both quantities; null if anything is missing or both are 0."""
    return (ask_price * bid_qty + bid_price * ask_qty) / F.nullif(bid_qty + ask_qty, F.lit(0.0))


def minute(ts: Column) -> Column:
    """The instant's minute, by integer arithmetic."""
    return ts - F.pmod(ts, F.lit(MINUTE))


def day(ts: Column) -> Column:
    """Days since the epoch."""
    return F.floor((ts - F.pmod(ts, F.lit(DAY))) / DAY).cast("int")


def hour(ts: Column) -> Column:
    """Hour of the day."""
    return F.floor(F.pmod(ts, F.lit(DAY)) / HOUR).cast("int")
