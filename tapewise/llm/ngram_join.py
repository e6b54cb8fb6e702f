"""N-gram Jaccard join with a count-vector R-tree.

Documents are sets of ``n`` consecutive lower-cased words, kept as 64-bit hashes.

1. Equal sets are found by a 128-bit hash; one representative, numbered, stands for them.
2. Representatives that can have a partner: two sets with Jaccard similarity t share a feature of the
   (1 - t) / (1 + t) * size + 1 rarest of the smaller set and of the (1 - t) * size + 1 rarest of the
   larger one.  Frequencies come from the sparse sketch of ``exchange``; a feature of a single set has
   no partner, so most documents drop out here.  Sets of one size that share a common text and differ
   in the rest never meet, unless they are similar.
3. The sets that have one rare feature are its posting; its smallest set is the posting's hub.  All
   postings of one hub are a group: similar sets meet in one.  Groups do not chain: a set that shares
   something with two others does not bring these together.  Those sets of a group ask for which the
   feature is one of the fewer rarest; the others only answer.
4. Small groups are joined in bundles, large ones in blocks with three of the group's sets in each,
   every bundle and block by an R-tree: a set's features, hashed into ``GROUPS`` groups, are counted;
   the count vectors are packed into leaves and nodes with their maxima.  The overlap of two sets is at
   most the sum of the minima of their counts, and the same holds for a set and a node, so nodes, leaves
   and then single sets are ruled out by ceil(t / (1 + t) * (sizes' sum)).  Pairs that survive are
   compared exactly, unless earlier links connect them already.
5. Sets outside the largest component of their large group ask again, by pairs of rare features: similar
   sets share two features of one more of the rarest.  These groups are joined likewise; only one
   that is still large is joined block by block.
Verified links make components; a document has that of its set.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .arrays import U64, lower_ascii, mix, short_hashes, slices, string_buffers, window_hashes, word_hashes, word_spans
from .common import discard, frugal, release, store
from .graph import components

N, THRESHOLD = 5, Fraction(4, 5)
GROUPS, LEAF, FAN = 64, 16, 8
BLOCK_SETS = 512
#: A feature with at least so many sets, as far as the sketch counts, and the tasks that its entries are dealt to.
HOT, SALTS = 255, 64


# ---- sets of hashed n-grams


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int):
    """(hashes, bounds): each row's sorted distinct n-grams; fewer words than n are one n-gram."""
    raw = lower_ascii(raw)
    starts, ends, rows = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    h, begin = window_hashes(words, rows, n)
    hr = rows[begin]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        h = np.concatenate((h, short_hashes(words, first[short], count[short])))
        hr = np.concatenate((hr, short))
        order = np.argsort(hr, kind="stable")
        h, hr = h[order], hr[order]
    bounds = np.searchsorted(hr, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (hr[1:] != hr[:-1])
    return h[new], np.searchsorted(hr[new], np.arange(len(offsets)))


def set_hashes(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; they do not depend on order."""
    out = []
    for salt in (3, 4):
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h, salt), dtype=U64)))
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(U64), salt).view(np.int64))
    return out[0], out[1]


# ---- the R-tree


def count_vectors(sets: list[np.ndarray]) -> np.ndarray:
    """How many of each set's features fall into each of GROUPS groups."""
    sizes = [len(s) for s in sets]
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    group = (flat >> U64(32)).astype(np.int64) % GROUPS
    return np.bincount(np.repeat(np.arange(len(sets)), sizes) * GROUPS + group, minlength=len(sets) * GROUPS).reshape(len(sets), GROUPS).astype(np.int32)


class RTree:
    """Points packed by size, then by their most varying groups; a node keeps its children's maxima and least size."""

    def __init__(self, points: np.ndarray) -> None:
        self.points, self.sizes = points, points.sum(axis=1)
        axes = np.argsort(-points.var(axis=0))[:2] if len(points) else np.zeros(2, int)
        order = np.argsort(self.sizes, kind="stable")
        # tiles of similar size, each sorted by one group and cut again by the next
        tiles = [o for t in np.array_split(order, max(1, round(len(order) / (LEAF * FAN)))) for o in np.array_split(t[np.argsort(points[t, axes[0]], kind="stable")], 2)]
        self.order = np.concatenate([t[np.argsort(points[t, axes[1]], kind="stable")] for t in tiles]) if len(order) else order
        tops, least = points[self.order], self.sizes[self.order]
        self.levels = []
        fan = LEAF
        while len(tops) > 1 or not self.levels:
            cuts = np.arange(0, len(tops), fan)
            if not len(cuts):
                break
            tops, least = np.maximum.reduceat(tops, cuts, axis=0), np.minimum.reduceat(least, cuts)
            self.levels.append((tops, least, fan))
            fan = FAN

    def candidates(self, q: np.ndarray, size: int, need) -> np.ndarray:
        """Points whose overlap with q, by the sum of minima, may reach need(sizes' sum)."""
        if not self.levels:
            return np.zeros(0, np.int64)
        at = np.arange(len(self.levels[-1][0]))
        below = [len(x[0]) for x in self.levels][::-1][1:] + [len(self.order)]
        for (tops, least, fan), n in zip(self.levels[::-1], below):
            at = at[np.minimum(tops[at], q).sum(axis=1) >= need(least[at] + size)]
            at = (at[:, None] * fan + np.arange(fan)).ravel()
            at = at[at < n]
        at = self.order[at]
        return at[np.minimum(self.points[at], q).sum(axis=1) >= need(self.sizes[at] + size)]


def join_sets(ids: np.ndarray, sets: list[np.ndarray], t: Fraction = THRESHOLD, queries: np.ndarray | None = None, tally: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, id) that span the same components as all pairs with similarity t or more.

    With ``queries`` (which sets ask), pairs of two others are left out.  ``tally`` counts pairs: all,
    those that the tree leaves, and those compared."""
    up, down = t.numerator, t.numerator + t.denominator
    need = lambda total: -(-up * total // down)
    vectors = count_vectors(sets)
    tree, label, out = RTree(vectors), np.arange(len(sets)), []
    seen = np.zeros(3, np.int64)
    for i in range(len(sets)) if queries is None else queries.tolist():
        near = tree.candidates(vectors[i], len(sets[i]), need)
        near = near[near < i] if queries is None else near[near != i]
        seen += (i if queries is None else len(sets) - 1, len(near), 0)
        near = near[label[near] != label[i]]
        # the likeliest first: one link settles all sets of a component
        near = near[np.argsort(-np.minimum(vectors[near], vectors[i]).sum(axis=1), kind="stable")]
        while len(near):
            j, near = int(near[0]), near[1:]
            seen[2] += 1
            if len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= need(len(sets[i]) + len(sets[j])):
                label[label == label[j]] = label[i]
                near = near[label[near] != label[i]]
                out.append((i, j))
    if tally is not None:
        for name, n in zip(("pairs", "left", "compared"), seen.tolist()):
            tally[name] = tally.get(name, 0) + n
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return ids[pairs[:, 0]], ids[pairs[:, 1]]


# ---- over a corpus

SETS_DDL = "doc_id long, text_hash long, n_shingles long, sid long, sid2 long"
SETS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("sid", pa.int64()), ("sid2", pa.int64())])
OFFER_DDL = "node long, keys binary, rare array<long>, n_answer int, n_ask int, n_ask_two int, n_cold int"
OFFER = pa.schema([("node", pa.int64()), ("keys", pa.binary()), ("rare", pa.list_(pa.int64())), *((c, pa.int32()) for c in ("n_answer", "n_ask", "n_ask_two", "n_cold"))])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
EDGES_DDL = "a long, b long"


def document_sets(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, and two hashes of the set, for each row of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            for a, b in slices(offsets):
                h, bounds = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                one, two = set_hashes(h, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(bounds), pa.int64()), pa.array(one), pa.array(two)], schema=SETS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(frugal(run), SETS_DDL)


def _representatives(docs: pa.Table, side: pa.Table, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The chunk's sets that stand for all their copies: numbers and features."""
    rows = side.to_pydict()
    wanted = {(s, s2): node for k, s, s2, node in zip(rows["kind"], rows["sid"], rows["sid2"], rows["node"]) if k == 0}
    ids, sets = [], []
    raw, offsets = string_buffers(docs.column("text"))
    for a, b in slices(offsets):
        h, bounds = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
        for i, s in enumerate(zip(*(x.tolist() for x in set_hashes(h, bounds)))):
            node = wanted.pop(s, None)
            if node is not None:
                ids.append(node)
                sets.append(h[bounds[i] : bounds[i + 1]])
    return np.array(ids, np.int64), sets


def similar_documents(docs: DataFrame, n: int = N, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included).

    One row for each row of ``docs`` (doc_id, text; other columns are ignored).  Rows without words,
    null texts included, have an empty set and link with nothing; rows with a null id have a size and
    a null component and link with nothing; rows with equal ids are judged each by its own text.  An
    empty table gives an empty table.
    """
    return document_classes(docs, n, threshold).select("doc_id", "n_shingles", "component_id")


#: Cells of the frequency sketch: the top 40 bits.
CELLS = U64((2**64 - 1) ^ (2**24 - 1))


def rare_features(s: np.ndarray, seen: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, int, int, int, int]:
    """(features, n_answer, n_ask, n_ask_two, n_cold) of a set whose features are in ``seen`` sets.

    The features of more than one set among the rarest, in the order that all sets share; how many of
    them are among those by which the set answers, asks, and asks by pairs; how many are not hot."""
    answer = len(s) - math.ceil(threshold * len(s)) + 1
    ask = len(s) - math.ceil(2 * threshold / (1 + threshold) * len(s)) + 1
    order = np.lexsort((s, seen))[: answer + 1]
    shared = seen[order] > 1
    return s[order[shared]], *(int(shared[:k].sum()) for k in (answer, ask, ask + 1)), int((shared & (seen[order] < HOT)).sum())


def document_classes(docs: DataFrame, n: int = N, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Columns of ``similar_documents``, xxhash64 of the row's text, and its component (null: none),
    which tells rows with equal ids and unlinked texts apart."""
    sets = store(document_sets(docs, n))
    known = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", F.xxhash64("text"))
    chunks, parts = X.plan(known)
    at = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(chunks)).cast("int").alias("chunk")
    rows = known.select("text", at)
    reps = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("sid", "sid2").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"))
    # numbers hold once they are stored
    reps = store(reps.select("sid", "sid2", "rep.*", F.monotonically_increasing_id().alias("node")))
    none = lambda kind: F.lit(None).cast(kind)
    wanted = reps.select(at, F.lit(0).alias("kind"), "sid", "sid2", "node", none("int").alias("slice"), none("binary").alias("reply"))

    def count(key: tuple[pa.Scalar, ...], table: pa.Table, side: pa.Table) -> pa.Table:
        _, found = _representatives(table, side, n)
        cells, counts = X.sketch(np.concatenate([np.zeros(0, U64), *found]) & CELLS)
        out = X.send(key[0].as_py(), cells, counts, parts)
        release()
        return out

    def offer(key: tuple[pa.Scalar, ...], table: pa.Table, side: pa.Table) -> pa.Table:
        ids, found = _representatives(table, side, n)
        reply = side.to_pydict()
        counts = X.replies([(s, r) for k, s, r in zip(reply["kind"], reply["slice"], reply["reply"]) if k == 1], np.uint8)
        flat = np.concatenate([np.zeros(0, U64), *found])
        cells, _ = X.sketch(flat & CELLS)
        seen = X.estimates(flat & CELLS, cells, counts)
        del flat, cells, counts, reply
        ends = np.cumsum([len(s) for s in found])
        rare = [rare_features(s, seen[e - len(s) : e], threshold) for s, e in zip(found, ends)]
        kept = [i for i, r in enumerate(rare) if r[1]]
        out = [pa.array(ids[kept], pa.int64()), pa.array([found[i].tobytes() for i in kept], pa.binary()), pa.array([rare[i][0].view(np.int64) for i in kept], pa.list_(pa.int64())), *(pa.array([rare[i][j] for i in kept], pa.int32()) for j in (1, 2, 3, 4))]
        release()
        return pa.Table.from_arrays(out, schema=OFFER)

    counted = rows.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(count, X.SENT_DDL).groupBy("slice").applyInArrow(X.totals, X.REPLY_DDL)
    counted = counted.select("chunk", F.lit(1).alias("kind"), none("long").alias("sid"), none("long").alias("sid2"), none("long").alias("node"), "slice", "reply")
    offers = store(rows.groupBy("chunk").cogroup(wanted.unionByName(counted).groupBy("chunk")).applyInArrow(offer, OFFER_DDL))
    linked = links(offers, threshold)
    roots = components(linked)
    # a component's smallest document, then each row's
    least = store(reps.withColumnRenamed("node", "own").join(roots, F.col("own") == F.col("node"), "left").select("sid", "sid2", F.col("doc_id").alias("rep"), F.coalesce("root", "own").alias("root")))
    smallest = store(least.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = store(least.join(smallest, "root").select(F.col("sid").alias("s1"), F.col("sid2").alias("s2"), F.col("root").alias("component"), "component_id"))
    for old in (offers, linked, roots, least, smallest, reps):
        discard(old)
    out = sets.join(named, (F.col("sid") == F.col("s1")) & (F.col("sid2") == F.col("s2")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "text_hash", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def _joined(threshold: Fraction):
    def run(table: pa.Table) -> pa.Table:
        """Joins the sets of one task."""
        node, asks, keys = table.column("node").to_numpy(), table.column("asks").to_numpy(), table.column("keys")
        first = np.unique(node, return_index=True)[1]  # a set of several groups, or a hub in its own block
        asked = np.zeros(len(first), bool)
        np.logical_or.at(asked, np.searchsorted(node[first], node), asks)
        sets = [np.frombuffer(keys[i].as_buffer(), U64) for i in first.tolist()]
        a, b = join_sets(node[first], sets, threshold, None if asked.all() else np.flatnonzero(asked))
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], schema=EDGES)

    return run


def _tasks(members: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Links within tasks; members: node, asks, task (group, part, other part)."""
    return members.join(sets.select(F.col("node").alias("n2"), "keys"), F.col("node") == F.col("n2")).select("task", "node", "asks", "keys").groupBy("task").applyInArrow(_joined(threshold), EDGES_DDL)


def _task(group, part, other) -> F.Column:
    return F.struct(group.cast("long").alias("g"), part.cast("long").alias("p"), other.cast("long").alias("q")).alias("task")


def _sized(members: DataFrame) -> tuple[DataFrame, int, int]:
    """Stored groups of (hub, node) that are larger than BLOCK_SETS, with three of their sets and their
    numbers of blocks; how many they are; the bundles that the other ones fill."""
    sizes = store(members.groupBy("hub").agg(F.count("*").alias("n"), F.max("node").alias("h2"), F.min_by("node", F.xxhash64("node")).alias("h3")))
    bundles = max(1, -(-(sizes.filter(F.col("n") <= BLOCK_SETS).agg(F.sum("n")).first()[0] or 0) // BLOCK_SETS))
    large = store(sizes.filter(F.col("n") > BLOCK_SETS).select(F.col("hub").alias("h1"), "h2", "h3", F.ceil(F.col("n") / BLOCK_SETS).alias("blocks")))
    discard(sizes)
    return large, large.count(), bundles


def _near(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n < 100_000 else df


def _placed(members: DataFrame, large: DataFrame, n_large: int) -> DataFrame:
    """members with ``blocks`` and ``block``, null in small groups."""
    out = members.join(_near(large.select("h1", "blocks"), n_large), F.col("hub") == F.col("h1"), "left").drop("h1")
    return out.withColumn("block", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))))


def _of_bundle(bundles: int) -> F.Column:
    return _task(F.lit(-1), F.pmod(F.xxhash64("hub"), F.lit(bundles)), F.lit(0))


def links(sets: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Links between ``sets`` (rows of OFFER), see steps 3 to 5."""
    entries = sets.select("node", "n_ask", "n_cold", F.posexplode(F.slice("rare", F.lit(1), F.col("n_answer"))).alias("at", "f"))
    # entries of hot features are dealt to several tasks; all sets agree on which features are hot
    hot = F.col("at") >= F.col("n_cold")
    entries = entries.select("node", "at", "f", hot.alias("hot"), (F.col("at") < F.col("n_ask")).alias("asks"), F.when(hot, F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt"))
    hubs = entries.groupBy("f").agg(F.min("node").alias("hub"), F.count("*").alias("n"), F.max("hot").alias("hot"), F.max("asks").alias("asked"))
    hubs = store(hubs.filter("n > 1 AND asked").select("f", "hub", "hot"))
    salted = hubs.select("f", "hub", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    met = entries.join(salted, ["f", "salt"])
    members = store(met.groupBy("hub", "node").agg(F.max("asks").alias("asks")))
    large, n_large, bundles = _sized(members)
    placed = _placed(members, large, n_large)
    own = placed.select("node", "asks", F.when(F.col("block").isNull(), _of_bundle(bundles)).otherwise(_task(F.col("hub"), F.col("block"), F.lit(0))).alias("task"))
    if n_large:
        hub_rows = large.select(F.explode(F.array_distinct(F.array("h1", "h2", "h3"))).alias("node"), "h1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("p"))
        own = own.unionByName(hub_rows.select("node", F.lit(True).alias("asks"), _task(F.col("h1"), F.col("p"), F.lit(0))))
    first = store(_tasks(own.distinct(), sets, threshold))
    out = first
    if n_large:
        rest = _rest(placed, first, n_large)
        if rest.limit(1).count():
            out = store(first.unionByName(_by_pairs(sets, met, rest, threshold)))
            discard(first)
        discard(rest)
    for old in (hubs, members, large):
        discard(old)
    return out


def _rest(placed: DataFrame, found: DataFrame, n_large: int) -> DataFrame:
    """Stored (hub, node) of large groups outside the group's largest component of ``found`` links."""
    roots = components(found)
    inside = placed.filter("block IS NOT NULL").join(roots.select(F.col("node").alias("n2"), "root"), F.col("node") == F.col("n2"), "left").select("hub", "node", F.coalesce("root", "node").alias("comp"))
    inside = store(inside)
    main = inside.groupBy("hub", "comp").agg(F.count("*").alias("c")).groupBy("hub").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    out = store(inside.join(_near(main.select(F.col("hub").alias("h1"), "main"), n_large), F.col("hub") == F.col("h1")).filter("comp <> main").select("hub", "node"))
    discard(inside)
    discard(roots)
    return out


def _by_pairs(sets: DataFrame, met: DataFrame, rest: DataFrame, threshold: Fraction) -> DataFrame:
    """Links of the ``rest`` (hub, node) with all sets of their groups, by pairs of rare features.

    Two different sets with similarity above 1/2 share two features at least; below that, the rare
    feature alone is the key."""
    two = threshold > Fraction(1, 2)
    open_ = rest.select("hub").distinct()
    of_rest = rest.select("hub", "node", F.lit(True).alias("asks"))
    # features of groups that have a rest, and whether the set is of it
    pairs = met.drop("asks").join(open_, "hub", "left_semi").join(of_rest, ["hub", "node"], "left").select("node", "f", "at", F.coalesce("asks", F.lit(False)).alias("asks"))
    both = pairs.join(sets.select(F.col("node").alias("n2"), "rare", "n_ask", "n_ask_two"), F.col("node") == F.col("n2"))
    if two:
        later = F.slice("rare", F.col("at") + 2, F.greatest(F.size("rare") - F.col("at") - 1, F.lit(0)))
        keyed = both.select("node", "asks", "f", "at", "n_ask", "n_ask_two", F.posexplode(later).alias("next", "g"))
        small = (F.col("at") < F.col("n_ask")) & (F.col("at") + 1 + F.col("next") < F.col("n_ask_two"))
    else:
        keyed, small = both.withColumn("g", F.lit(0).cast("long")), F.col("at") < F.col("n_ask")
    keyed = store(keyed.select("node", "asks", small.alias("small"), F.xxhash64("f", "g").alias("key")))
    wanted = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("asks").alias("asked"), F.max("small").alias("has_small"), F.min("node").alias("hub")).filter("n > 1 AND asked AND has_small").select("key", "hub")
    members = store(keyed.join(wanted, "key").groupBy("hub", "node").agg(F.max("asks").alias("asks")))
    large, n_large, bundles = _sized(members)
    placed = _placed(members, large, n_large)
    out = _tasks(placed.filter("block IS NULL").select("node", "asks", _of_bundle(bundles)).distinct(), sets, threshold)
    if n_large:
        # still large: those that ask, in blocks, meet all blocks
        inside = store(placed.filter("block IS NOT NULL").select("hub", "node", "asks", "block", "blocks"))
        all_blocks = lambda: F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        ask = inside.filter("asks").select("node", "asks", "hub", "block", all_blocks().alias("q"))
        present = inside.filter("asks").select(F.col("hub").alias("h1"), F.col("block").alias("p")).distinct()
        asked = inside.join(present, F.col("hub") == F.col("h1")).select("node", F.lit(False).alias("asks"), _task(F.col("hub"), F.col("p"), F.col("block")))
        out = out.unionByName(_tasks(ask.select("node", "asks", _task(F.col("hub"), F.col("block"), F.col("q"))).unionByName(asked), sets, threshold))
    return out
