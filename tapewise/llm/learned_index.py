"""Approximate nearest neighbours with learned partitions.

On a bounded sample a graph of nearest neighbours is cut into balanced parts (bisections along the
slowest mode of a random walk, then exchanges of pairs that cut fewer edges), and a small network
learns each vector's part, softened by the parts of its neighbours; biases keep what it assigns
balanced.  The network then deals every vector to one part, and a query to its most probable parts, as
many as gave the wished recall on the sample; these are searched in full, with exact scores.  Where
``TOP`` parts would have more than ``PART_ROWS`` vectors each, every part is cut again in the same way,
by a network of its own, fitted on a bounded sample of the part.  Neighbouring parts lie on one shelf, a
task's work: a query goes there once for all its parts of the shelf, and brings back its k best of them.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store
from .vectors import HITS, HITS_DDL, best, matrix, spread, top

SAMPLE, NEIGHBOURS, HIDDEN, PART_ROWS, SHELVES, BLOCK_ROWS, RECALL = 4096, 16, 64, 1500, 8, 16384, 0.93
LEAST_PARTS, TOP = 8, 256


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k others with the largest inner products."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect(graph: np.ndarray, members: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``members`` that few edges of ``graph`` join."""
    local = np.full(len(graph), -1)
    local[members] = np.arange(len(members))
    near = local[graph[members]]
    inside = near >= 0
    src, dst = np.nonzero(inside)[0], near[inside]
    degree = np.bincount(src, minlength=len(members)) + np.bincount(dst, minlength=len(members)) + 1.0
    y = rng.standard_normal(len(members))
    for _ in range(60):
        y = (np.bincount(src, y[dst], len(members)) + np.bincount(dst, y[src], len(members)) + y) / degree
        y -= (degree @ y) / degree.sum()
        y /= np.abs(y).max() + 1e-12
    right = np.zeros(len(members), bool)
    right[np.argsort(y, kind="stable")[len(members) // 2 :]] = True
    for _ in range(8):
        other = np.bincount(src, right[src] != right[dst], len(members)) + np.bincount(dst, right[src] != right[dst], len(members))
        gain = 2 * other - (degree - 1)
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        n = min(len(a), len(b), max(1, len(members) // 20))
        swap = gain[a[:n]] + gain[b[:n]] > 2
        if not swap.any():
            break
        right[a[:n][swap]], right[b[:n][swap]] = True, False
    return members[~right], members[right]


def partition(graph: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """A part for each row, of equal sizes up to one; ``parts`` is a power of two."""
    rng, pieces = np.random.default_rng(seed), [np.arange(len(graph))]
    while len(pieces) < parts:
        pieces = [half for piece in pieces for half in bisect(graph, piece, rng)]
    out = np.empty(len(graph), np.int64)
    for i, piece in enumerate(pieces):
        out[piece] = i
    return out


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int
    home_bias: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def logits(self, x: np.ndarray) -> np.ndarray:
        y = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)
        return np.maximum(y @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def home(self, x: np.ndarray) -> np.ndarray:
        """The part that each vector is kept in."""
        return (self.logits(x) + self.home_bias).argmax(axis=1)

    def asked(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The most probable parts of each query."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :probes]


def fit(x: np.ndarray, parts: int, k: int, recall: float = RECALL, seed: int = 0, epochs: int = 60) -> Router:
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    net = Router(rng.standard_normal((dim, HIDDEN)) * (2 / dim) ** 0.5 * 2, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * 0.2, np.zeros(parts), parts)
    if parts == 1 or len(x) < 4 * parts:
        return net  # too few rows to tell parts apart: all are asked
    near = neighbours(x, min(NEIGHBOURS, len(x) - 1))
    label = partition(near, parts, seed)
    soft = np.eye(parts)[label] * 0.5
    for j in range(near.shape[1]):
        np.add.at(soft, (np.arange(len(x)), label[near[:, j]]), 0.5 / near.shape[1])
    y = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)
    state, t = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, net.b2)], 0
    for epoch in range(epochs):
        for ids in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            h = np.maximum(y[ids] @ net.w1 + net.b1, 0)
            z = h @ net.w2 + net.b2
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - soft[ids]) / len(ids)
            gh = g @ net.w2.T * (h > 0)
            t += 1
            for part, grad, (m, v) in zip((net.w1, net.b1, net.w2, net.b2), (y[ids].T @ gh, gh.sum(0), h.T @ g, g.sum(0)), state):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                part -= 0.01 * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    # parts of one size: what is too large gets a lower bias
    z, net.home_bias = net.logits(x), np.zeros(parts)
    for step in range(100):
        sizes = np.bincount((z + net.home_bias).argmax(axis=1), minlength=parts)
        net.home_bias -= 0.3 / (1 + step / 10) * z.std() * np.clip(sizes / (len(x) / parts) - 1, -1, 1)
    # as many parts as find the wished share of the sample's own neighbours
    home = net.home(x)
    ask = rng.permutation(len(x))[:512]
    qi, xi, _ = best(ask, x[ask], np.arange(len(x)), x, min(k, len(x) - 1))
    order = np.argsort(-net.logits(x), axis=1)
    place = np.argsort(order, axis=1)[qi, home[xi]]
    hits = np.cumsum(np.bincount(place, minlength=parts)) / len(place)
    net.probes = int(np.searchsorted(hits, recall) + 1)
    return net


def levels(n: int) -> tuple[int, int]:
    """(parts, parts of each part): of about PART_ROWS rows, LEAST_PARTS at least."""
    wanted = max(LEAST_PARTS, 1 << max(0, round(math.log2(max(1, n / PART_ROWS)))))
    return min(wanted, TOP), min(TOP, max(1, wanted // TOP))


@dataclass
class Index:
    """The router over parts, and where these are cut again, one router for each part."""

    first: Router
    parts: int
    below: dict[int, Router]
    sub: int

    def home(self, x: np.ndarray) -> np.ndarray:
        at = self.first.home(x)
        out = at * self.sub
        for i in np.unique(at).tolist() if self.sub > 1 else []:
            if i in self.below:
                out[at == i] += self.below[i].home(x[at == i])
        return out

    def asked(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, part): sorted pairs; ``probes`` parts, and of each the router's own number of subparts."""
        at = self.first.asked(x, probes)
        if self.sub == 1:
            return np.repeat(np.arange(len(x)), probes), np.sort(at, axis=1).ravel()
        rows, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.unique(at).tolist():
            q = np.flatnonzero((at == i).any(axis=1))
            net = self.below.get(i)
            sub = net.asked(x[q], net.probes) if net else np.zeros((len(q), 1), np.int64)
            rows.append(np.repeat(q, sub.shape[1]))
            parts.append((i * self.sub + sub).ravel())
        row, part = np.concatenate(rows), np.concatenate(parts)
        order = np.lexsort((part, row))
        return row[order], part[order]


def _fit_part(sub: int, k: int, recall: float, seed: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = matrix(table.column("v"))[np.argsort(table.column("o").to_numpy(), kind="stable")[:SAMPLE]]
        net = pickle.dumps(fit(x, sub, k, recall, seed))
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([net], pa.binary())], names=["part", "net"])

    return run


def build(data: DataFrame, n: int, k: int, sample: int = SAMPLE, recall: float = RECALL, seed: int = 0) -> Index:
    """The index of ``data`` (vec_id, v), ``n`` rows, fitted on ``sample`` rows and as many of each part cut again."""
    parts, sub = levels(n)
    order = F.xxhash64(F.lit(seed), "vec_id")
    x = matrix(data.orderBy(order, "v").limit(sample).select("v").toArrow().column(0))
    each = recall if sub == 1 else recall**0.5
    index = Index(fit(x, parts, k, each, seed), parts, {}, 1)
    if sub > 1:
        net = data.sparkSession.sparkContext.broadcast(index.first)  # some 200 kB
        # twice the rows that a part's fit takes, by hash; parts are balanced
        few = data.filter(F.pmod(F.xxhash64(F.lit(seed), F.lit(1), "vec_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 2 * SAMPLE * parts / n)))

        def where(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(net.value.home(matrix(batch.column(0))).astype(np.int32)), batch.column(0), batch.column(1)], names=["part", "v", "o"])

        fitted = few.select("v", order.alias("o")).mapInArrow(where, "part int, v array<double>, o long").groupBy("part").applyInArrow(_fit_part(sub, k, each, seed), "part int, net binary")
        # TOP routers of at most some 200 kB
        index.below, index.sub = {r["part"]: pickle.loads(r["net"]) for r in fitted.collect()}, sub
    return index


def search(data: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE, recall: float = RECALL, seed: int = 0, told: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``data`` (vec_id, v) for which ``is_query`` holds,
    the k largest inner products found with rows of other ids, ties to the smaller vec_id.

    All rows are indexed; zero vectors take no part.  Rows with equal ids and vectors count once; of one
    id with different vectors each is a vector of its own, and the id's queries share one ranking.
    Other columns are ignored, whatever their names.  With too few rows to fill k in the parts that are
    asked, more parts are.  ``told`` is given the number of parts, the share of all (query, vector)
    pairs that is searched, and the largest part.
    """
    data = data.select("vec_id", "v", is_query.alias("asks")).filter(F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"])
    n = data.count()
    spark = data.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = build(data, n, k, sample, recall, seed)
    net, parts = spark.sparkContext.broadcast(index), index.parts * index.sub  # at most 50 MB: see ``build``

    def home(batches):
        for batch in batches:
            if batch.num_rows:
                at = net.value.home(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.astype(np.int32))], names=["vec_id", "v", "part"])

    shelves = min(parts, max(SHELVES, parts // 32))
    shelf = F.floor(F.col("part") * shelves / parts).cast("int")
    indexed = data.select("vec_id", "v").mapInArrow(home, "vec_id long, v array<double>, part int").withColumn("shelf", shelf)
    if index.sub > 1:
        indexed = store(indexed)
    sizes = {r[0]: r[1] for r in indexed.groupBy("part").count().collect()}  # parts rows
    # the fewest rows that the probed parts can have must fill k
    smallest = {i: min(sizes.get(i * index.sub + j, 0) for j in range(index.sub)) for i in range(index.parts)}
    small = np.sort([smallest[i] * (index.below[i].probes if i in index.below else 1) for i in range(index.parts)])
    probes = index.first.probes
    while probes < index.parts and small[:probes].sum() <= k:
        probes += 1
    loads = np.bincount([i * shelves // parts for i in sizes], list(sizes.values()), shelves).astype(int).tolist()
    blocks = {j: max(1, -(-n // BLOCK_ROWS)) for j, n in enumerate(loads)}

    def route(batches):
        """A row for each query and shelf, with the query's parts there."""
        for batch in batches:
            if batch.num_rows:
                row, chosen = net.value.asked(matrix(batch.column(1)), probes)
                at = chosen * shelves // parts
                first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1]))))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(chosen.astype(np.int32)))
                take = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), lists, pa.array(at[first].astype(np.int32))], names=["vec_id", "v", "parts", "shelf"])

    of = F.create_map(*[F.lit(y) for kv in blocks.items() for y in kv])
    asked = data.filter("asks").select("vec_id", "v").mapInArrow(route, "vec_id long, v array<double>, parts array<int>, shelf int")
    if told is not None:
        told |= {"parts": parts, "largest": max(sizes.values()), "rows": n}
        told["share"] = sum(sizes.get(r[0], 0) * r[1] for r in asked.select(F.explode("parts").alias("p")).groupBy("p").count().collect()) / n / max(1, data.filter("asks").count())
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), of[F.col("shelf")].cast("int") - 1)))
    # a shelf's queries are dealt out too, so that no task has more than some thousands
    n_asked = {r[0]: r[1] for r in asked.groupBy("shelf").count().collect()}
    turns = {i: max(1, -(-n_asked.get(i, 0) // (blocks[i] * 8192))) for i in range(shelves)}
    turn = F.create_map(*[F.lit(y) for kv in turns.items() for y in kv])
    asked = asked.withColumn("turn", spread(turn[F.col("shelf")]))
    placed = indexed.withColumn("block", spread(of[F.col("shelf")])).withColumn("turn", F.explode(F.sequence(F.lit(0), turn[F.col("shelf")].cast("int") - 1)))
    keys = ["shelf", "block", "turn"]
    hits = asked.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(_shelf_search(k), HITS_DDL)
    return top(hits, k)


def _shelf_search(k: int):
    """A cogroup step: queries (vec_id, v, parts) against vectors (vec_id, v, part) of one shelf."""

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not queries.num_rows or not data.num_rows:
            return HITS.empty_table()
        q_ids, q, ids, x = queries.column("vec_id").to_numpy(), matrix(queries.column("v")), data.column("vec_id").to_numpy(), matrix(data.column("v"))
        part, lists = data.column("part").to_numpy(), queries.column("parts").combine_chunks()
        asks, wanted = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        found = []
        for p in np.unique(wanted):
            mine, rows = asks[wanted == p], np.flatnonzero(part == p)
            if len(rows):
                found.append(best(q_ids[mine], q[mine], ids[rows], x[rows], k))
        if not found:
            return HITS.empty_table()
        a, b, s = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        return pa.Table.from_arrays([pa.array(a[keep].astype(np.int64)), pa.array(b[keep].astype(np.int64)), pa.array(s[keep].astype(np.float64))], schema=HITS)

    return run
