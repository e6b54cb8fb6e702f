"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into chunks of ``CHUNK`` bytes that overlap by ``OVERLAP``
and cover all of it.  Filters over ``TAPS`` consecutive bytes (looked up, byte
by byte, in learned tables, which is a convolution of one-hot bytes) and over a
plane that tells how far the last 32 bytes repeat those a few places before
are max-pooled in each chunk; a hidden layer gives each chunk its features;
their maximum and mean over all chunks give the document's probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from . import training as T

CHUNK, OVERLAP, STRIDE, TAPS, FILTERS, HIDDEN, LEVELS = 512, 64, 4, 8, 16, 12, 33
LAGS = range(2, 25)
TRAIN_CHUNKS = 8


def repeats(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """At each byte: of the 32 bytes from here, how many equal the one ``lag`` before, at the best lag within the document."""
    best = np.zeros(len(raw), np.uint8)
    sizes = np.diff(offsets)
    longest = LAGS[-1]
    # how far back each byte's document goes, up to the longest lag
    back = np.full(len(raw), longest, np.uint8)
    for k in range(longest):
        back[offsets[:-1][sizes > k] + k] = k
    for lag in LAGS:
        if len(raw) < lag + 32:
            break
        run = (raw[lag:] == raw[:-lag]).view(np.uint8)
        for step in (1, 2, 4, 8, 16):
            run = run[:-step] + run[step:]
        run = run * (back[lag : lag + len(run)] >= lag)
        np.maximum(best[lag : lag + len(run)], run, out=best[lag : lag + len(run)])
    return best


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, repeats at filter places, document) of all chunks; short ones are padded with zeros."""
    sizes = np.diff(offsets)
    step = CHUNK - OVERLAP
    counts = np.maximum(1, -(-(sizes - OVERLAP) // step))
    doc = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start, end = offsets[doc] + nth * step, offsets[doc + 1]
    padded = np.concatenate((raw, np.zeros(CHUNK, np.uint8)))
    x = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[start]
    short = np.flatnonzero(end - start < CHUNK)
    if len(short):
        x[short] *= np.arange(CHUNK)[None, :] < (end - start)[short, None]
    plane = np.concatenate((repeats(raw, offsets), np.zeros(CHUNK, np.uint8)))
    places = np.arange(0, CHUNK - TAPS + 1, STRIDE)
    r = plane[start[:, None] + places[None, :]]
    r[(places[None, :] + 32) > (end - start)[:, None]] = 0
    return x, r, doc


@dataclass
class Network:
    """Tables of byte filters, of the repeat plane, hidden layer and output."""

    taps: np.ndarray
    levels: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        levels = f(LEVELS, FILTERS, scale=0.1) + np.linspace(0, 1, LEVELS, dtype=np.float32)[:, None] * f(1, FILTERS, scale=1.0)
        return Network(f(TAPS, 256, FILTERS, scale=0.25), levels, np.zeros(FILTERS, np.float32), f(FILTERS, HIDDEN, scale=0.35), np.full(HIDDEN, 0.05, np.float32), f(2 * HIDDEN, scale=0.2), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.taps, self.levels, self.bias, self.w1, self.b1, self.w2, self.b2]

    def pooled(self, x: np.ndarray, r: np.ndarray, where: bool = False):
        """Each chunk's maximum of each filter, and its place."""
        n = r.shape[1]
        out, places = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int32) if where else None
        for a in range(0, len(x), 256):
            xs = x[a : a + 256]
            z = np.take(self.levels, r[a : a + 256], axis=0)
            for k in range(TAPS):
                z += np.take(self.taps[k], xs[:, k : k + STRIDE * n : STRIDE][:, :n], axis=0)
            out[a : a + 256] = z.max(axis=1)
            if where:
                places[a : a + 256] = z.argmax(axis=1)
        return out, places

    def forward(self, pooled: np.ndarray, doc: np.ndarray, n: int):
        act = np.maximum(pooled + self.bias, 0)
        hidden = np.maximum(act @ self.w1 + self.b1, 0)
        first = np.searchsorted(doc, np.arange(n))
        top = np.maximum.reduceat(hidden, first, axis=0)
        counts = np.diff(np.append(first, len(doc)))[:, None].astype(np.float32)
        mean = np.add.reduceat(hidden, first, axis=0) / counts
        both = np.concatenate((top, mean), axis=1)
        return act, hidden, first, counts, both, 1 / (1 + np.exp(-np.clip(both @ self.w2 + self.b2, -30, 30)))

    def probabilities(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, r, doc = chunks(raw, offsets)
        return self.forward(self.pooled(x, r)[0], doc, len(offsets) - 1)[-1].astype(np.float64)


def fit(texts: list[bytes], y: np.ndarray, seed: int = 0, epochs: int = 14, batch: int = 32, rate: float = 0.01) -> Network:
    """Adam on the log loss, classes weighted alike, over up to ``TRAIN_CHUNKS`` chunks of each sampled text an epoch."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed + 1)
    if not len(y) or len(set(y.tolist())) < 2:
        net.w2[:] = 0
        net.b2[:] = np.log((np.sum(y) + 1) / (len(y) - np.sum(y) + 1))
        return net
    x, r, doc = chunks(*T.joined(texts))
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    # the prior stays that of the sample at hand: without the rarer class's weight the rest would hide it
    weight = np.where(y > 0, 0.5 / max(1, np.sum(y > 0)), 0.5 / max(1, np.sum(y == 0))) * len(y)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    t = 0
    epochs = max(epochs, -(-500 // max(1, len(texts) // batch)))  # a small sample needs as many steps
    for epoch in range(epochs):
        lr = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.02)
        for ids in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            pick = [np.sort(rng.permutation(np.arange(first[i], first[i + 1]))[:TRAIN_CHUNKS]) for i in ids]
            rows, d = np.concatenate(pick), np.repeat(np.arange(len(ids)), [len(p) for p in pick])
            xs, rs = x[rows], r[rows]
            pooled, places = net.pooled(xs, rs, True)
            act, hidden, starts, counts, both, p = net.forward(pooled, d, len(ids))
            g = ((p - y[ids]) * weight[ids] / len(ids)).astype(np.float32)
            g_w2, g_b2, g_both = both.T @ g, np.array([g.sum()], np.float32), g[:, None] * net.w2[None, :]
            g_hidden = (g_both[:, HIDDEN:] / counts)[d]
            is_top = hidden == both[d, :HIDDEN]
            share = np.add.reduceat(is_top.astype(np.float32), starts, axis=0)
            g_hidden = g_hidden + is_top * (g_both[:, :HIDDEN] / np.maximum(share, 1))[d]
            g_hidden = g_hidden * (hidden > 0)
            g_w1, g_b1 = act.T @ g_hidden, g_hidden.sum(0)
            g_act = (g_hidden @ net.w1.T) * (act > 0)
            f = np.arange(FILTERS)[None, :]
            line = np.arange(len(xs))[:, None]
            g_taps = np.stack([np.bincount((xs[line, places * STRIDE + k].astype(np.int64) * FILTERS + f).ravel(), g_act.ravel(), 256 * FILTERS).reshape(256, FILTERS) for k in range(TAPS)])
            g_levels = np.bincount((rs[line, places].astype(np.int64) * FILTERS + f).ravel(), g_act.ravel(), LEVELS * FILTERS).reshape(LEVELS, FILTERS)
            t += 1
            for part, grad, (m, v) in zip(net.parts(), (g_taps, g_levels, g_act.sum(0), g_w1, g_b1, g_w2, g_b2), state):
                grad = grad.astype(np.float32)
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                part -= lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) + (1e-5 * part if part.ndim > 1 else 0)
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = T.SAMPLE_ROWS, most_bytes: int = T.SAMPLE_BYTES, seed: int = 0) -> Network:
    """The network fitted on a sample of labelled rows, bounded by ``rows`` of each class and ``most_bytes`` of text.

    Null ids and labels other than 0 and 1 are left out; of an id's labels the largest counts, of its texts
    the largest; a null text is empty.  Without both labels the network gives every document one probability."""
    return fit(*T.sample(docs, labels, label, rows, most_bytes, seed), seed=seed)


def score(docs: DataFrame, net: Network, columns: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``columns`` of each row of ``docs`` and ``name``, the probability of label 1, from its whole text.

    A null text is scored as an empty one; rows with equal ids, and null ids, are scored each for
    itself; other columns are ignored; an empty table gives an empty table.
    """
    fields = docs.select(*columns).schema
    schema = to_arrow_schema(fields).append(pa.field(name, pa.float64()))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", {name} double"
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 150 kB, whatever the corpus
    return T.score_texts(docs, lambda raw, offsets: [shared.value.probabilities(raw, offsets)], ddl, schema, columns)
