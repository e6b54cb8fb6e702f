"""Query op9_learned_index.  Approximate, so SQL cannot give its rows; tests measure recall against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .learned_index import search
from .vectors import usable


def op9_learned_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(usable(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, 20)


QUERIES = {"op9_learned_index": op9_learned_index}
ORACLES: dict[str, str] = {}
