"""Substring dedup behind a count-min prefilter.

A window is ``width`` consecutive words of one document.  A window's words are
removed from a document when the same word sequence also starts in a document
with a smaller id.  Three passes over chunks of documents (see ``exchange``):

1. each chunk counts its windows in a sparse count-min sketch of 2**40 cells,
   a document once per cell; slices of the sketches are merged by adding, and
   each chunk gets back the estimates of its own cells.  Estimates are never
   too low, so a window estimated at 1 is in one document only;
2. windows estimated repeated go, once for each chunk, with the smallest
   document that has them there, to exact grouping by a 128-bit hash;
3. a chunk hears for which of them a smaller document exists elsewhere, and
   takes the covered words out of its whole texts.

The sketch is never held in one place, nothing is broadcast, and a passage that
stands in a third of all documents is one entry for each chunk.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .arrays import U64, mix, slices, string_buffers, window_hashes, word_hashes, word_spans
from .common import bounded_batches, release

WIDTH = 13
CELL_BITS = 40
NO_ID = np.iinfo(np.int64).max
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
OUT_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _ids(docs: pa.Table) -> np.ndarray:
    return docs.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _windows(docs: pa.Table, width: int, salts: tuple[int, ...]):
    """For each slice of rows: first row, words' spans and rows, first words and hashes of windows."""
    raw, offsets = string_buffers(docs.column("text"))
    for a, b in slices(offsets):
        part, offs = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, rows = word_spans(part, offs)
        hashes = []
        first = np.zeros(0, np.int64)
        for salt in salts:
            h, first = window_hashes(word_hashes(part, starts, ends, salt), rows, width, salt)
            hashes.append(h)
        yield a, b, rows, first, hashes


def _cells(hashes: np.ndarray) -> np.ndarray:
    """The sketch's cell of each window, as the top bits of 64."""
    return mix(hashes, 7) & U64((2**64 - 1) ^ (2 ** (64 - CELL_BITS) - 1))


def _document_cells(docs: pa.Table, width: int) -> np.ndarray:
    """Each document's distinct cells, all documents' together."""
    found, ids = [np.zeros(0, U64)], _ids(docs)
    for a, _, rows, first, (h,) in _windows(docs, width, (0,)):
        cells, row = _cells(h), ids[a + rows[first]]
        if len(cells):
            order = np.lexsort((row, cells))
            c, r = cells[order], row[order]
            new = np.concatenate(([True], (c[1:] != c[:-1]) | (r[1:] != r[:-1])))
            found.append(c[new])
    return np.concatenate(found)


def _candidates(docs: pa.Table, width: int, counts: np.ndarray):
    """Chunk's windows that are estimated repeated: sorted distinct keys, second hashes and smallest ids,
    and for each slice of rows which windows have which key."""
    ids, found = _ids(docs), list(_windows(docs, width, (0, 1)))
    # the chunk's own cells in order, as the sketch has sent them
    _, at = np.unique(np.concatenate([np.zeros(0, U64), *(_cells(h) for *_, (h, _) in found)]), return_inverse=True)
    repeated, done, parts = counts[at] >= 2, 0, []
    for a, b, rows, first, (h, h2) in found:
        seen = repeated[done : done + len(h)]
        done += len(h)
        parts.append((a, b, len(rows), rows, first[seen], h[seen], h2[seen], ids[a + rows[first[seen]]]))
    h = np.concatenate([np.zeros(0, U64), *(p[5] for p in parts)])
    h2 = np.concatenate([np.zeros(0, U64), *(p[6] for p in parts)])
    doc = np.concatenate([np.zeros(0, np.int64), *(p[7] for p in parts)])
    order = np.lexsort((h2, h))
    hs, h2s = h[order], h2[order]
    start = np.concatenate(([True], (hs[1:] != hs[:-1]) | (h2s[1:] != h2s[:-1]))) if len(hs) else np.zeros(0, bool)
    first = np.flatnonzero(start)
    least = np.minimum.reduceat(doc[order], first) if len(first) else np.zeros(0, np.int64)
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(start) - 1
    return parts, hs[first], h2s[first], least, which


VALUE = np.dtype([("h2", "<u8"), ("doc", "<i8")])


def _exact(table: pa.Table) -> pa.Table:
    """For each entry: 1 if another chunk has the same window in a smaller document."""

    def solve(keys: np.ndarray, values: np.ndarray, _: np.ndarray) -> np.ndarray:
        order = np.lexsort((values["h2"], keys))
        k, v = keys[order], values[order]
        first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (v["h2"][1:] != v["h2"][:-1]))))
        least = np.repeat(np.minimum.reduceat(v["doc"], first), np.diff(np.append(first, len(k))))
        out = np.empty(len(k), np.uint8)
        out[order] = least < v["doc"]
        return out

    return X.answer(table, VALUE, solve)


def _replies(side: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    rows = side.to_pydict()
    return [(s, r) for k, s, r in zip(rows["kind"], rows["slice"], rows["reply"]) if k == kind]


def _removed(docs: pa.Table, width: int, side: pa.Table, texts: bool) -> pa.Table:
    counts, smaller = X.replies(_replies(side, 1), np.uint8), X.replies(_replies(side, 2), np.uint8)
    parts, _, _, least, which = _candidates(docs, width, counts)
    ids, column, at = _ids(docs), docs.column("text"), 0
    n_words, n_removed, digests, kept_texts = [], [], [], []
    for a, b, n, rows, first, _, _, doc in parts:
        key = which[at : at + len(first)]
        at += len(first)
        hit = first[(smaller[key] > 0) | (doc > least[key])] if len(first) else first
        depth = np.zeros(n + 1, np.int64)
        np.add.at(depth, hit, 1)
        np.add.at(depth, hit + width, -1)
        gone = np.cumsum(depth[:-1]) > 0
        bounds = np.searchsorted(rows, np.arange(b - a + 1))
        for i, text in enumerate(column.slice(a, b - a).to_pylist()):
            lost = gone[bounds[i] : bounds[i + 1]]
            words = (text or "").encode().split()
            kept = b" ".join(compress(words, (~lost).tolist()) if lost.any() else words)
            n_words.append(len(lost))
            n_removed.append(int(lost.sum()))
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode() if texts else None)
    return pa.Table.from_arrays([docs.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())], schema=OUT)


def dedup_substrings(docs: DataFrame, width: int = WIDTH, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if ``texts``, the kept words joined by one space.

    One row for each row of ``docs`` (doc_id, text; other columns are ignored).  A null text has no
    words; a null doc_id counts as larger than every other; rows with one doc_id are one document,
    so that they never take words from each other; an empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    chunks, parts = X.plan(docs)
    rows = X.dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chunks, "doc_id", "text")
    by_chunk = lambda: rows.groupBy("chunk")

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cells, counts = X.sketch(_document_cells(table, width))
        release()
        return X.send(key[0].as_py(), cells, counts, parts)

    def offer(key: tuple[pa.Scalar, ...], table: pa.Table, side: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.SENT.empty_table()
        _, keys, h2, least, _ = _candidates(table, width, X.replies(_replies(side, 1), np.uint8))
        release()
        # one key may stand for several windows that differ in h2 only: differences of 0 are fine
        return X.send(key[0].as_py(), keys, np.rec.fromarrays([h2, least], dtype=VALUE) if len(keys) else np.zeros(0, VALUE), parts)

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table, side: pa.Table) -> pa.Table:
        out = _removed(table, width, side, texts) if table.num_rows else OUT.empty_table()
        release()
        return out

    counted = by_chunk().applyInArrow(count, X.SENT_DDL).groupBy("slice").applyInArrow(X.totals, X.REPLY_DDL).withColumn("kind", F.lit(1))
    exact = by_chunk().cogroup(counted.groupBy("chunk")).applyInArrow(offer, X.SENT_DDL).groupBy("slice").applyInArrow(_exact, X.REPLY_DDL).withColumn("kind", F.lit(2))
    return by_chunk().cogroup(counted.unionByName(exact).groupBy("chunk")).applyInArrow(finish, OUT_DDL)
