"""Vector columns in and out of numpy, and the local step of both searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(vec_id, v): rows with an id and a vector of finite components, of the commonest length.

    Vectors of another length, which have no inner product with the rest, take no part; nor do null and
    empty ones.  Other columns are ignored, whatever their names."""
    v = F.col(column).cast("array<double>")
    fine = F.col(id_column).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = df.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).filter(F.coalesce(fine, F.lit(False)))
    common = out.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return out.filter(F.size("v") == (common["n"] if common else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last, as a plain loop does."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, slack: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, inner product): each query's k largest and, within ``slack``, their ties; never its own id."""
    out: list[list[np.ndarray]] = [[], [], []]
    for a in range(0, len(q), 128):
        s = q[a : a + 128] @ x.T
        s[q_ids[a : a + 128, None] == ids[None, :]] = -np.inf
        cut = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        cut = cut - slack * np.maximum(1, np.abs(cut)) if slack else cut
        i, j = np.nonzero((s >= np.where(np.isnan(cut), -np.inf, cut)[:, None]) & (s > -np.inf))
        exact = in_order(q[a + i], x[j])
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, np.arange(len(s)))
        keep = np.arange(len(i)) - first[i] < k
        for to, y in zip(out, (q_ids[a + i[keep]], ids[j[keep]], exact[keep])):
            to.append(y)
    return tuple(np.concatenate(y) if y else np.zeros(0) for y in out)  # type: ignore[return-value]


HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
HITS_DDL = "query_id long, vec_id long, score double"


def local_search(k: int, slack: float = 1e-9):
    """A cogroup step: queries (vec_id, v) against vectors (vec_id, v) of one cell."""

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not queries.num_rows or not data.num_rows:
            return HITS.empty_table()
        qi, di = queries.column("vec_id").to_numpy(), data.column("vec_id").to_numpy()
        a, b, s = best(qi, matrix(queries.column("v")), di, matrix(data.column("v")), k, slack)
        return pa.Table.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(s.astype(np.float64))], schema=HITS)

    return run


def top(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all cells' hits, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def spread(parts: Column) -> Column:
    """A number below ``parts`` for each row, by its id."""
    return F.pmod(F.xxhash64("vec_id", F.lit(5)), parts).cast("int")
