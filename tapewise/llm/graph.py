"""Connected components of an edge table, without collecting edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of ``edges`` (a, b: long): root is the smallest node reachable.

    Every round hooks each root onto its smallest neighbour if that is smaller, follows hooks to their
    ends by pointer doubling, and contracts edges to pairs of different roots, until none is left.
    What is a root after two rounds is at most half of what was one before them, so rounds are
    logarithmic whatever the order of nodes.  Both sides of a round's joins are stored tables, so that
    a node with very many edges is a partition that Spark can split, and all sums are combined before
    they are shuffled.
    """
    both = edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    live, roots = store(both), None
    while True:
        hooks = _ends(store(live.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))))
        up = hooks.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        half = store(live.join(up, F.col("a") == F.col("n2")).select(F.col("r2").alias("a"), "b"))
        pairs = store(half.join(up, F.col("b") == F.col("n2")).select("a", F.col("r2").alias("b")).filter("a <> b").distinct())
        named = hooks if roots is None else store(roots.join(up, F.col("root") == F.col("n2"), "left").select("node", F.coalesce("r2", "root").alias("root")))
        for old in (live, half, *(() if roots is None else (roots, hooks))):
            discard(old)
        live, roots = pairs, named
        if not live.limit(1).count():
            discard(live)
            return roots


def _ends(hooks: DataFrame) -> DataFrame:
    """Each node of ``hooks`` (stored; node, root) with the node where its chain of roots ends."""
    while True:
        up = hooks.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        jumped = store(hooks.join(up, F.col("root") == F.col("n2")).select("node", F.col("root").alias("was"), F.col("r2").alias("root")))
        changed = jumped.filter("was <> root").limit(1).count()
        discard(hooks)
        hooks = jumped.select("node", "root")
        if not changed:
            return hooks
