"""Bounded samples of labelled rows for fitting, and scores mapped over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices, string_buffers
from .common import bounded_batches, frugal

#: The bound of a fit: rows of each class, and bytes of text in all.
SAMPLE_ROWS = 1000
SAMPLE_BYTES = 6_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, seed: int = 0, longest: int = SAMPLE_BYTES // 20) -> tuple[list[bytes], np.ndarray]:
    """(texts, labels) of up to ``rows`` labelled documents of each class, picked by a hash of the id.

    The sample serves fitting only; texts are taken whole, in the order of the hash, and one that does
    not fit into what is left of ``most_bytes``, or has more than ``longest`` bytes, is passed over.
    """
    own = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    picked = own.filter("_y = 1").orderBy(order).limit(rows).unionByName(own.filter("_y = 0").orderBy(order).limit(rows))
    small = F.broadcast(picked)  # at most 2 * rows ids
    found = docs.select("doc_id", "text").join(small, "doc_id").withColumn("_o", order).groupBy("doc_id", "_y", "_o").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max(F.octet_length(F.coalesce("text", F.lit("")))).alias("_n"))
    got = found.filter(F.col("_n") <= min(longest, most_bytes)).orderBy("_o", "doc_id").select("text", "_y").limit(2 * rows).toArrow().to_pydict()
    texts, y, used = [], [], 0
    for text, label_of in zip(got["text"], got["_y"]):
        raw = text.encode()
        if used + len(raw) > most_bytes:
            continue
        used += len(raw)
        texts.append(raw)
        y.append(label_of)
    return texts, np.array(y, np.float32)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def score_texts(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], ddl: str, schema: pa.Schema, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of each row, and what ``score`` says of its text (null: empty), slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column(batch.schema.get_field_index("text")))
            for a, b in slices(offsets):
                got = score(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                kept = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in columns]
                yield pa.RecordBatch.from_arrays([c.cast(schema.field(i).type) for i, c in enumerate([*kept, *(pa.array(g) for g in got)])], schema=schema)

    bounded_batches(docs.sparkSession)
    return docs.select(*columns, *(["text"] if "text" not in columns else [])).mapInArrow(frugal(run), ddl)
