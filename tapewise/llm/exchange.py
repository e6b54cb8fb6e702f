"""Counting hashed features of a whole corpus without moving its rows.

Documents are dealt to chunks.  A chunk sums up its own features first (so a
feature that is in a third of all documents is one entry of each chunk), sorts
them by hash and sends every range of hashes, a slice, as one packed row.  A
slice meets the entries of all chunks, and answers each chunk with one packed
row in the order in which the chunk has sent them.  No task sees more than a
chunk or a slice: their sizes are fixed and their numbers grow with the corpus,
so that a task takes as much memory at every size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, pack_u64, unpack_u64

SENT = pa.schema([("slice", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])
SENT_DDL = "slice int, chunk int, keys binary, values binary"
REPLY = pa.schema([("chunk", pa.int32()), ("slice", pa.int32()), ("reply", pa.binary())])
REPLY_DDL = "chunk int, slice int, reply binary"
CHUNK_BYTES = 2e6


def plan(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(chunks, slices) for the bytes of text: chunks of CHUNK_BYTES, slices of about a million words."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, math.ceil(total / CHUNK_BYTES)), max(16, math.ceil(total / 6e6))


def dealt(docs: DataFrame, chunks: int, *columns: str) -> DataFrame:
    """Rows with the chunk that they belong to; copies and null ids are spread by their text."""
    return docs.select(*columns, F.pmod(F.xxhash64(*columns), F.lit(chunks)).cast("int").alias("chunk"))


def slice_bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of 64-bit hashes begins in sorted keys."""
    width = 2**64 // n + 1
    edges = np.array([i * width for i in range(1, n)], dtype=U64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def send(chunk: int, keys: np.ndarray, values: np.ndarray, n: int) -> pa.Table:
    """One row for each slice that has keys (sorted, distinct), with their values.

    Keys go as differences, whose high bytes are zero."""
    bounds = slice_bounds(keys, n)
    full = np.flatnonzero(np.diff(bounds))
    out_keys, out_values = [], []
    for i in full:
        a, b = bounds[i], bounds[i + 1]
        part = keys[a:b].copy()
        part[1:] -= keys[a : b - 1]
        out_keys.append(pack_u64(part))
        out_values.append(np.ascontiguousarray(values[a:b]).tobytes())
    return pa.Table.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk, np.int32)), pa.array(out_keys, pa.binary()), pa.array(out_values, pa.binary())], schema=SENT)


def received(raw: bytes) -> np.ndarray:
    """The sorted keys of one packed row."""
    return np.cumsum(unpack_u64(raw), dtype=U64)


def answer(table: pa.Table, dtype: np.dtype, solve: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> pa.Table:
    """Joins a slice's packed rows; solve(keys, values, which row) gives an answer for each entry."""
    rows = table.to_pydict()
    keys = [received(k) for k in rows["keys"]]
    sizes = np.array([len(k) for k in keys])
    values = np.frombuffer(b"".join(rows["values"]), dtype)
    out = solve(np.concatenate(keys), values, np.repeat(np.arange(len(keys)), sizes))
    ends = np.cumsum(sizes)
    return pa.Table.from_arrays([pa.array(rows["chunk"], pa.int32()), pa.array(rows["slice"], pa.int32()), pa.array([out[e - s : e].tobytes() for s, e in zip(sizes, ends)], pa.binary())], schema=REPLY)


def replies(rows: list[tuple[int, bytes]], dtype: np.dtype) -> np.ndarray:
    """All answers to a chunk, in the order of its sorted keys."""
    return np.frombuffer(b"".join(b for _, b in sorted(rows)), dtype)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys, and where each group of equal ones begins."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)


def totals(table: pa.Table) -> pa.Table:
    """Merges partition sketches: the counts of equal cells, summed up to 255."""

    def solve(keys: np.ndarray, counts: np.ndarray, _: np.ndarray) -> np.ndarray:
        order, first = grouped(keys)
        sums = np.add.reduceat(counts[order].astype(np.int64), first)
        out = np.empty(len(keys), np.uint8)
        out[order] = np.repeat(np.minimum(sums, 255), np.diff(np.append(first, len(keys)))).astype(np.uint8)
        return out

    return answer(table, np.uint8, solve)


def sketch(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct cells and their counts up to 255."""
    if not len(cells):
        return cells, np.zeros(0, np.uint8)
    cells = np.sort(cells)
    first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    return cells[first], np.minimum(np.diff(np.append(first, len(cells))), 255).astype(np.uint8)


def estimates(cells: np.ndarray, own: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """Each cell's merged count, given the chunk's sorted distinct cells and the answers to them."""
    return answers[np.searchsorted(own, cells)]
