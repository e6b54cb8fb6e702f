"""Operators over trades."""

from .arrival import arrival_features
from .late import drop_late, late_totals
from .rolling import rolling_features

__all__ = ["arrival_features", "compute_features", "drop_late", "late_totals", "rolling_features"]


def compute_features(trades, mode: str = "event_time", **options):
    """Feature rows of ``trades`` (see ``schemas.SEQUENCED``): "event_time" folds accepted late trades
    into the windows that they belong to, "arrival" replays the stream row by row."""
    if mode == "event_time":
        return rolling_features(drop_late(trades), **options)
    if mode == "arrival":
        return arrival_features(trades, **options)
    raise ValueError(f"mode {mode!r} is neither event_time nor arrival")
