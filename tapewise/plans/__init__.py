"""Canonical queries."""

from .canonical import SQL, FeatureQueries

__all__ = ["SQL", "FeatureQueries"]
