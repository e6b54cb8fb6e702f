"""Searches on clustered vectors, on two levels of parts, on awkward rows, and what they rule out."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewise.llm import learned_index, topk_join
from tapewise.llm.vectors import usable


def clustered(n, centres=40, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim)) * 3
    return c[rng.integers(0, centres, n)] + rng.standard_normal((n, dim)) * 0.15


def frame(spark, x):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, v array<double>")


def brute(x, asks, k):
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    return {q: sorted((-s[q, i], i) for i in np.argsort(-s[q])[: k + 5])[:k] for q in asks}


def test_bounds_rule_out_most_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk_join, "SENDING", 20)  # so that few queries already pay for small groups
    x = np.floor(clustered(6000) * 64)
    told = {}
    got = defaultdict(list)
    for r in topk_join.exact_top(frame(spark, x), F.col("vec_id") % 10 == 0, 10, told=told).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    assert dict(got) == brute(x, range(0, 6000, 10), 10)
    searched = sum(q * s for q, s in zip(told["queries"], told["shares"])) / sum(told["queries"])
    assert searched < 0.5 and len(told["queries"]) > 1


def test_two_levels_of_parts(spark, monkeypatch):
    monkeypatch.setattr(learned_index, "TOP", 8)
    monkeypatch.setattr(learned_index, "PART_ROWS", 60)
    x = clustered(3000, centres=60)
    assert learned_index.levels(3000) == (8, 8) and learned_index.levels(10**9)[1] == 8
    told = {}
    got = defaultdict(list)
    for r in learned_index.search(frame(spark, x), F.col("vec_id") % 20 == 0, 20, told=told).collect():
        got[r["query_id"]].append(r["vec_id"])
    want = brute(x, range(0, 3000, 20), 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for _, i in want[q]} & set(v)) / 20 for q, v in got.items()]) >= 0.9
    assert told["share"] < 0.6 and told["parts"] == 64


@pytest.mark.parametrize("n", [25, 170, 500, 2000])
def test_small_tables_go_through_parts_too(spark, n):
    """At every size the rows are dealt to parts; scattered vectors need most of them for the recall."""
    x = np.random.default_rng(n).standard_normal((n, 16))
    told = {}
    got = defaultdict(list)
    rows = learned_index.search(frame(spark, x), F.col("vec_id") % 20 == 0, 20, told=told).collect()
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    want = brute(x, range(0, n, 20), 20)
    assert told["parts"] >= 8
    for q, v in got.items():
        assert v == sorted(v) and len(v) == min(20, n - 1)
    assert np.mean([len({i for _, i in want[q]} & {i for _, i in v}) / len(v) for q, v in got.items()]) >= 0.9


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (2, [1.0, 0.0], "b"), (2, [0.5, 0.0], "b"), (3, [], "c"), (4, None, "c"), (5, [1.0, 2.0, 3.0], "d"), (6, [float("inf"), 0.0], "e"), (20, [0.0, 0.0], "z"), (40, [2.0, None], "z")]
    table = spark.createDataFrame([(i, v, s, s, 1) for i, v, s in rows], "vec_id long, embedding array<double>, cell string, part string, asks int")
    v = usable(table)
    for found in (topk_join.exact_top(v, F.col("vec_id") % 20 == 0, 10), learned_index.search(v, F.col("vec_id") % 20 == 0, 10)):
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect() if r["query_id"] == 0 and r["score"] != 0}
        assert got == {(0, 1): (1, 1.0), (0, 2): (2, 1.0), (0, 3): (2, 0.5)}
    with_clash = table.filter("vec_id < 3").withColumn("v", F.col("embedding"))
    assert topk_join.exact_top(with_clash, F.lit(True), 2).count() == learned_index.search(with_clash, F.lit(True), 2).count() == 6
