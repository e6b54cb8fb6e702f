"""Query op4_toxicity.  SQL cannot express a random field; tests hold it to brute force and to held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .common import remainder, table

THRESHOLD = 0.3


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = toxicity.train(docs, labels.filter(remainder("doc_id", 4) != 2))
    tagged = toxicity.tag(docs, field)
    offending = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")  # start:end, code points
    return tagged.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"), offending.alias("spans"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
