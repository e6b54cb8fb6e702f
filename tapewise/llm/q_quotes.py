"""Query op3_quotes.  Tests compare it with brute force on random nested conversations, as the tables quote nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quotes import conversations


def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"), placeless=True)


QUERIES = {"op3_quotes": op3_quotes}
ORACLES: dict[str, str] = {}
