"""Feature rows from streams of trades."""

from .features import stream_features, to_features

__all__ = ["stream_features", "to_features"]
