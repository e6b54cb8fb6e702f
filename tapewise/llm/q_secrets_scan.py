"""Query op7_secrets_scan.  SQL cannot express the network's spans; tests hold the base ones to the patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import secrets_scan
from .common import table


def op7_secrets_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets_scan.scan(docs, secrets_scan.train(docs)).drop("found")


QUERIES = {"op7_secrets_scan": op7_secrets_scan}
ORACLES: dict[str, str] = {}
