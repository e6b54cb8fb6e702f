"""Exact top-k inner products by a Voronoi join.

With M the largest norm, |x|**2 + (M**2 - |x|**2) = M**2, so appending sqrt(M**2 - |x|**2) to a vector
and 0 to a query turns the largest inner product into the smallest distance.  Vectors and queries go
to the nearest of some pivots, about as many as the root of the vectors.  Summaries of the cells
(counts, the least and largest distance to the pivot, the k + 1 least) bound how far the k-th neighbour
of any query of a cell can be; a vector goes only to the groups of query cells for which neither the
triangle inequality nor Cauchy and Schwarz's can rule it out: x * q <= x * p + |x| |q - p| must reach
the k-th best score that the cell's queries have in a bounded sample.  How many cells make a group is
chosen by what the sample says of the work: clustered data take small groups, of which each needs few
vectors, scattered data large ones.  Groups are solved locally, in blocks of bounded size, and the
blocks' best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import HITS_DDL, local_search, matrix, spread, top

MOST_PIVOTS, GROUP_QUERIES, BLOCK_ROWS, SAMPLE = 2048, 1024, 16384, 4096
#: What it costs to send a vector, in inner products.
SENDING = 200
CELL = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int32()), ("dist", pa.float64())])
CELL_DDL = "vec_id long, v array<double>, cell int, dist double"


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))[:, None]), axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def in_cells(df: DataFrame, pivots: np.ndarray, most: float, query: bool) -> DataFrame:
    """Rows (vec_id, v) with their pivot, the nearest one, and its distance when both are lifted."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)  # MOST_PIVOTS rows at most

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            y = np.concatenate((x, np.zeros((len(x), 1))), axis=1) if query else _lifted(x, most)
            d = _distances(y, shared.value)
            # queries gather around bare pivots, which makes their cells small
            at = (_distances(x, shared.value[:, :-1]) if query else d).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(x)), at])], schema=CELL)

    return df.select("vec_id", "v").mapInArrow(run, CELL_DDL)


def _asking(queries: DataFrame, pivots: np.ndarray, ids: np.ndarray, sample: np.ndarray, k: int) -> DataFrame:
    """Queries in their cells, with the distance to the unlifted pivot and the k-th best score in the sample."""
    shared = queries.sparkSession.sparkContext.broadcast((pivots, ids, sample))  # bounded by MOST_PIVOTS and SAMPLE

    def run(batches):
        p, own, x = shared.value
        for batch in batches:
            q, cell, q_ids = matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(0).to_numpy()
            if not len(q):
                continue
            least = np.full(len(q), -np.inf)
            for a in range(0, len(q), 256):
                s = q[a : a + 256] @ x.T
                s[q_ids[a : a + 256, None] == own[None, :]] = -np.inf
                if s.shape[1] >= k:
                    least[a : a + 256] = np.partition(s, -k, axis=1)[:, -k]
            far = np.sqrt(((q - p[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far), pa.array(least)], names=["vec_id", "v", "cell", "dist", "far", "least"])

    return queries.mapInArrow(run, f"{CELL_DDL}, far double, least double")


class Bounds:
    """Which vectors the queries of a cell may need; a line for each query cell."""

    def __init__(self, cells: list[int], pivots: np.ndarray, between: np.ndarray, width: dict, reach: dict, far: dict, least: dict) -> None:
        self.between = between[cells]
        self.width, self.reach, self.far, self.least = (np.array([of[i] for i in cells]) for of in (width, reach, far, least))
        self.pivots = pivots[cells]

    def need(self, x: np.ndarray, cell: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """(vectors, query cells): False where a bound rules the vector out for all queries of the cell."""
        b = self.between[:, cell].T
        d = dist[:, None]
        near = (b - self.width - d <= self.reach) & (d - self.width - b <= self.reach)
        norm = np.sqrt((x * x).sum(axis=1))[:, None]
        score = x @ self.pivots.T + norm * self.far
        return near & (score * (1 + 1e-9) + 1e-6 * (1 + norm) >= self.least)


def groupings(chain: list[int], counts: dict[int, int], need: np.ndarray, place: dict[int, int], n: int) -> tuple[list[list[int]], np.ndarray]:
    """Runs of ``chain`` (query cells) as groups, and the share of the sample that each needs; the
    sizes of groups are those that cost least, as the sample has it (``need``: rows, query cells)."""
    best: tuple[float, list[list[int]], np.ndarray] | None = None
    for size in (GROUP_QUERIES, GROUP_QUERIES // 4, GROUP_QUERIES // 16, GROUP_QUERIES // 64):
        groups: list[list[int]] = [[]]
        for i in chain:
            if groups[-1] and sum(counts[j] for j in groups[-1]) >= size:
                groups.append([])
            groups[-1].append(i)
        share = np.array([need[:, [place[i] for i in g]].any(axis=1).mean() for g in groups])
        cost = float(sum(s * n * (SENDING + sum(counts[i] for i in g)) for s, g in zip(share, groups)))
        if best is None or cost < best[0]:
            best = cost, groups, share
    assert best is not None
    return best[1], best[2]


def _least(k: int):
    def run(table: pa.Table) -> pa.Table:
        return table.sort_by("dist").slice(0, k)

    return run


def exact_top(data: DataFrame, is_query: Column, k: int = 10, pivots: int | None = None, whole: bool = True, told: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for rows (vec_id, v) of equal lengths, see ``vectors.usable``.

    Each row for which ``is_query`` holds asks for its k largest inner products with rows of other ids
    (all, if fewer), ties to the smaller vec_id.  Rows with equal ids and equal vectors count once; of
    one id with different vectors each is a vector of its own, and the id's queries share one ranking.
    Other columns are ignored, whatever their names.  No queries or no other rows: no result rows.
    ``whole``: components are integers, whose sums are exact.  ``told`` is given the groups' queries
    and shares of the sample.
    """
    data = data.select("vec_id", "v", is_query.alias("asks")).dropDuplicates(["vec_id", "v"])
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    most, n, n_queries = data.agg(F.max(norm), F.count("*"), F.sum(F.col("asks").cast("long"))).first()
    spark = data.sparkSession
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a bounded sample, for pivots and bounds only
    picked = data.orderBy(F.xxhash64("vec_id"), "v").limit(SAMPLE).select("vec_id", "v").toArrow()
    ids, x = picked.column(0).to_numpy(), matrix(picked.column(1))
    bare = x[: pivots or min(MOST_PIVOTS, max(16, round(n**0.5)))]
    p = _lifted(bare, most)
    queries = _asking(in_cells(data.filter("asks"), p, most, True), bare, ids, x, k)
    cells = in_cells(data, p, most, False)
    near = cells.mapInArrow(_nearest_parts(k + 1), "cell int, dist double").groupBy("cell").applyInArrow(_least(k + 1), "cell int, dist double").toArrow()  # pivots * (k + 1) numbers
    of_queries = {r[0]: r[1:] for r in queries.groupBy("cell").agg(F.count("*"), F.max("dist"), F.max("far"), F.min("least")).collect()}
    between = _distances(p, p)
    cell, dist = near.column(0).to_numpy(), near.column(1).to_numpy()
    # how far the k-th neighbour of a query of cell i can be; one more, for the query itself
    reach = {}
    for i, (_, u, _, _) in of_queries.items():
        far = np.sort(u + between[i, cell] + dist)
        reach[i] = far[k] * (1 + 1e-9) + 1e-6 if len(far) > k else np.inf
    chain = _chain(between, sorted(of_queries))
    counts, width, span, least = ({i: of_queries[i][j] for i in chain} for j in range(4))
    bounds = Bounds(chain, bare, between, width, reach, span, least)
    d = _distances(_lifted(x, most), p)
    own = d.argmin(axis=1)
    need = bounds.need(x, own, d[np.arange(len(x)), own])
    groups, share = groupings(chain, counts, need, {i: j for j, i in enumerate(chain)}, n)
    if told is not None:
        told |= {"queries": [sum(counts[i] for i in g) for g in groups], "shares": share.tolist()}
    load = (share * len(x) + 3 * np.sqrt(share * len(x)) + 3) / len(x) * n
    blocks = {g: max(1, int(-(-y // BLOCK_ROWS))) for g, y in enumerate(load)}
    q_blocks = {g: max(1, -(-sum(counts[i] for i in c) // (2 * GROUP_QUERIES))) for g, c in enumerate(groups)}
    group_of = {i: g for g, c in enumerate(groups) for i in c}
    ends = np.cumsum([len(c) for c in groups])
    shared = spark.sparkContext.broadcast((bounds, ends - [len(c) for c in groups]))  # some pivots and numbers

    def targets(batches):
        rules, first = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            c, d = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            need = np.logical_or.reduceat(rules.need(matrix(batch.column(1)), c, d), first, axis=1)
            at, g = np.nonzero(need)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(g.astype(np.int32))], schema=pa.schema([CELL.field(0), CELL.field(1), ("grp", pa.int32())]))

    as_map = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    sent = cells.mapInArrow(targets, "vec_id long, v array<double>, grp int").withColumn("block", spread(as_map(blocks)[F.col("grp")]))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), as_map(q_blocks)[F.col("grp")].cast("int") - 1)))
    asked = queries.withColumn("grp", as_map(group_of)[F.col("cell")].cast("int")).withColumn("part", spread(as_map(q_blocks)[F.col("grp")]))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), as_map(blocks)[F.col("grp")].cast("int") - 1)))
    keys = ["grp", "part", "block"]
    hits = asked.select("vec_id", "v", *keys).groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(local_search(k, 0.0 if whole else 1e-9), HITS_DDL)
    return top(hits, k)


def _nearest_parts(k: int):
    def run(batches):
        """Each cell's k least distances within a partition."""
        kept_c, kept_d = np.zeros(0, np.int32), np.zeros(0)
        for batch in batches:
            c, d = np.concatenate((kept_c, batch.column(2).to_numpy())), np.concatenate((kept_d, batch.column(3).to_numpy()))
            order = np.lexsort((d, c))
            c, d = c[order], d[order]
            first = np.searchsorted(c, c)
            few = np.arange(len(c)) - first < k
            kept_c, kept_d = c[few], d[few]
        yield pa.RecordBatch.from_arrays([pa.array(kept_c.astype(np.int32)), pa.array(kept_d)], names=["cell", "dist"])

    return run


def _chain(between: np.ndarray, cells: list[int]) -> list[int]:
    """Cells in an order in which each follows a near one."""
    rest, out = np.array(cells[1:], np.int64), list(cells[:1])
    while len(rest):
        j = int(between[out[-1], rest].argmin())
        out.append(int(rest[j]))
        rest = np.delete(rest, j)
    return out
