"""From documents to training pieces: quality, near duplicates, secrets, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``.  ``run`` stores what a stage returns and reads it back before the next, so that no
stage is worked out twice and a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewise.llm import mixing, ngram_join, pieces, quality, secrets_scan
from tapewise.llm.common import discard, settled, table, unused


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labelled ones, does not reject.

    A null text is judged as an empty one and stays null; null ids and repeated rows are judged each for
    itself; a text of any length is read whole; further columns may have any names; an empty table stays empty."""
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "_quality")
    return quality.score(docs, net, tuple(docs.columns), name).filter(f"`{name}` >= 0.5").drop(name)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity 0.8 links, the one with the smallest id, once.

    Rows with one id and unlinked texts are kept one for each component; texts without words (null ones
    too) link with nothing and are kept, one of each id and text; rows with a null id stay, all of them;
    of rows that repeat id and text one stays, whatever its further columns, which may have any names;
    an empty table stays empty."""
    classes = ngram_join.document_classes(docs).filter("doc_id = component_id")
    kept = classes.groupBy("doc_id", "component", F.when(F.col("component").isNull(), F.col("text_hash")).alias("alone")).agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash")
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    once = rows.filter("doc_id IS NOT NULL").join(kept, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return once.unionByName(rows.filter("doc_id IS NULL")).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, findings replaced by a mask; n_chars follows the text.

    A null text stays null with its n_chars; null ids and repeated rows are scanned each for itself; a text
    of any length is read whole; further columns may have any names; an empty table stays empty."""
    clean = secrets_scan.redact(docs, secrets_scan.train(docs))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each document and pass in which the mix shows some of it.

    Null, empty, long and repeated rows and clashing columns as in ``mixing.mixed_documents``."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces, lossless; null, empty, long and repeated rows as in ``pieces.encode_texts``."""
    return pieces.encode_texts(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage has stored goes when the next has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
