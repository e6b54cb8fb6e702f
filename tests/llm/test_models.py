"""The quality network against plain loops, and the columns of the toxicity query."""

import random

import numpy as np
import pytest

from tapewise.llm import q_toxicity, quality
from tapewise.llm.training import joined


def plainly(net, raw):
    """The probability of one text, by the definition."""
    n, step, features = len(raw), quality.CHUNK - quality.OVERLAP, []
    repeat = lambda p: max([sum(raw[p + j] == raw[p + j - lag] for j in range(32)) for lag in quality.LAGS if p >= lag], default=0)
    for begin in range(0, max(1, n - quality.OVERLAP), step):
        chunk = (raw[begin : begin + quality.CHUNK] + bytes(quality.CHUNK))[: quality.CHUNK]
        best = np.full(quality.FILTERS, -np.inf)
        for place in range(0, quality.CHUNK - quality.TAPS + 1, quality.STRIDE):
            level = repeat(begin + place) if begin + place + 32 <= n else 0
            z = net.levels[level].astype(float) + sum(net.taps[k][chunk[place + k]].astype(float) for k in range(quality.TAPS))
            best = np.maximum(best, z)
        features.append(np.maximum(np.maximum(best + net.bias, 0) @ net.w1 + net.b1, 0))
    features = np.array(features)
    z = np.concatenate((features.max(axis=0), features.mean(axis=0))) @ net.w2 + net.b2[0]
    return 1 / (1 + np.exp(-z))


def texts():
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choice("abc dé. ") for _ in range(n)).encode()
    return [b"", b"a", prose(31), prose(40), b"ab" * 60, prose(450), b"xyz " * 140, prose(512), prose(700) + b"z" * 300, b"z" * 40, prose(1300)]


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_network_equals_plain_loops(seed):
    net = quality.Network.fresh(seed)
    want = [plainly(net, t) for t in texts()]
    assert net.probabilities(*joined(texts())) == pytest.approx(want, abs=1e-4)


def test_a_score_does_not_depend_on_the_texts_beside_it():
    net = quality.Network.fresh(3)
    alone = {t: float(net.probabilities(*joined([t]))[0]) for t in texts()}
    for seed in range(4):
        order = texts() * 2
        random.Random(seed).shuffle(order)
        assert net.probabilities(*joined(order)) == pytest.approx([alone[t] for t in order], abs=1e-5)


def test_toxicity_query_names_the_offsets(spark):
    folder = "/root/testdata/sf0.01"
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = q_toxicity.op4_toxicity(spark, folder).collect()
    assert len(rows) == len(text) and any(r["n_spans"] for r in rows)
    for r in rows:
        spans = [tuple(map(int, s.split(":"))) for s in r["spans"].split(",")] if r["spans"] else []
        assert len(spans) == r["n_spans"] and spans == sorted(spans)
        assert all(0 <= a < b <= len(text[r["doc_id"]]) for a, b in spans)
