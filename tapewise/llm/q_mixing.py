"""Query op1_mixing.  SQL has neither the keyed hash nor the permutations; tests compare with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .mixing import mix, taken


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, slots = mix(table(spark, sf_dir, "documents"))
    return taken(placed, slots).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_mixing": op1_mixing}
ORACLES: dict[str, str] = {}
