"""Query op10_quality.  SQL cannot express a network; tests hold it to plain loops and to its accuracy on held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .common import remainder, table

THRESHOLD = 0.5


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality.train(docs, labels.filter(remainder("doc_id", 3) != 1))
    scored = quality.score(docs, net)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
