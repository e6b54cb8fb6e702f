"""Query op2_pieces.  SQL cannot express the agenda; tests hold it to a plain one and to an exact round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .pieces import encode_texts


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op2_pieces": op2_pieces}
ORACLES: dict[str, str] = {}
