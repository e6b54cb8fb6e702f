"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters and digits in lower case.  Each has hashed features:
itself, its prefixes of 4 to 7 bytes and its suffix of 3; two states, toxic or
not, follow each other with learned transition weights.  Labels exist for whole
documents only, so the fit labels tokens first: a token of a toxic document is
toxic if one of its features occurs in toxic documents far more often than in
others; near copies count once, by the least hash of three tokens of their document.
Forward-backward marginals give spans, and their sum and maximum, through a
logistic function fitted on documents that the field has not seen, the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import training as T
from .arrays import U64, Hasher, characters_before, lower_ascii, mix, spans_of

BITS = 18
N_FEATURES = 6
SPAN_AT = 0.5
BLOCK = 128
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and hashed features (one line a feature) of all tokens."""
    starts, ends, rows = spans_of(_TOKEN[raw], offsets)
    h = Hasher(lower_ascii(raw))
    found = [h(starts, ends, 1), *(h(starts, np.minimum(starts + k, ends), k) for k in (4, 5, 6, 7)), h(np.maximum(ends - 3, starts), ends, 3)]
    return starts, ends, rows, np.stack([(x >> U64(64 - BITS)).astype(np.int32) for x in found])


def _scan(m: np.ndarray) -> np.ndarray:
    """Products of all 2 x 2 matrices up to each place within blocks; m has shape (4, BLOCK, blocks)."""
    out = np.empty_like(m)
    out[:, 0] = m[:, 0]
    for t in range(1, m.shape[1]):
        a, b, c, d = out[:, t - 1]
        e, f, g, h = m[:, t]
        row = np.stack((a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h))
        out[:, t] = row / row.sum(axis=0)
    return out


def _blocks(m: np.ndarray) -> np.ndarray:
    """(4, n) -> (4, BLOCK, blocks), filled up with the identity."""
    n = m.shape[1]
    k = max(1, -(-n // BLOCK))
    full = np.zeros((4, k * BLOCK))
    full[0, n:] = full[3, n:] = 1
    full[:, :n] = m
    return np.ascontiguousarray(full.reshape(4, k, BLOCK).transpose(0, 2, 1))


def _vectors(m: np.ndarray, first: tuple[float, float]) -> np.ndarray:
    """first * m[0] * ... * m[t], for all t, normalised; m has shape (4, n)."""
    p = _scan(_blocks(m))
    k = p.shape[2]
    entry = np.empty((2, k))
    x, y = first
    for i, (a, b, c, d) in enumerate(p[:, -1].T.tolist()):
        entry[0, i], entry[1, i] = x, y
        x, y = x * a + y * c, x * b + y * d
        x, y = x / (x + y), y / (x + y)
    out = np.stack((entry[0] * p[0] + entry[1] * p[2], entry[0] * p[1] + entry[1] * p[3]))
    out /= out.sum(axis=0)
    return out.transpose(0, 2, 1).reshape(2, -1)[:, : m.shape[1]]


@dataclass
class Field:
    """Weights of features (for the toxic state), of transitions and of starts; the score's weights."""

    weights: np.ndarray
    bias: float
    trans: np.ndarray
    start: np.ndarray
    logit: np.ndarray

    def emissions(self, feats: np.ndarray) -> np.ndarray:
        out = np.full(feats.shape[1], self.bias)
        for f in range(N_FEATURES):
            out += self.weights[f][feats[f]]
        return np.clip(out, -25, 25)

    def chain(self, feats: np.ndarray, rows: np.ndarray):
        """Marginals of the toxic state, and what the pairs' marginals need."""
        e = np.exp(self.emissions(feats))
        begins = np.concatenate(([True], rows[1:] != rows[:-1]))
        t, s = np.exp(self.trans), np.exp(self.start)
        m = np.stack((np.where(begins, s[0], t[0, 0]), np.where(begins, s[1], t[0, 1]) * e, np.where(begins, s[0], t[1, 0]), np.where(begins, s[1], t[1, 1]) * e))
        alpha = _vectors(m, (0.5, 0.5))
        # backwards: beta[t - 1] = m[t] beta[t], as a row vector times the transposed matrices in reverse
        back = _vectors(m[[0, 2, 1, 3]][:, ::-1], (0.5, 0.5))[:, ::-1]
        beta = np.concatenate((back[:, 1:], np.full((2, 1), 0.5)), axis=1)
        both = alpha * beta
        return both[1] / both.sum(axis=0), alpha, beta, m, begins

    def documents(self, marginals: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Of each document: logarithms of its expected toxic tokens and of their share, its highest marginal."""
        total = np.bincount(rows, marginals, n)
        share = (total + 0.01) / (np.bincount(rows, minlength=n) + 20)
        top = np.zeros(n)
        if len(rows):
            first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            top[rows[first]] = np.maximum.reduceat(marginals, first)
        return np.stack((np.log(total + 0.01), np.log(share) + 7, top, np.ones(n)))

    def score(self, raw: np.ndarray, offsets: np.ndarray):
        """Scores of documents; spans (first and last token joined where toxic ones follow each other)."""
        starts, ends, rows, feats = tokens(raw, offsets)
        n = len(offsets) - 1
        p = self.chain(feats, rows)[0] if len(rows) else np.zeros(0)
        scores = 1 / (1 + np.exp(-np.clip(self.logit @ self.documents(p, rows, n), -30, 30)))
        on = p >= SPAN_AT
        first = np.flatnonzero(on & np.concatenate(([True], ~on[:-1] | (rows[1:] != rows[:-1])))) if len(on) else np.zeros(0, int)
        last = np.flatnonzero(on & np.concatenate((~on[1:] | (rows[1:] != rows[:-1]), [True]))) if len(on) else np.zeros(0, int)
        chars = characters_before(raw)
        base = chars[offsets[rows[first]]]
        struct = pa.StructArray.from_arrays([pa.array(chars[starts[first]] - base, pa.int64()), pa.array(chars[ends[last]] - base, pa.int64())], ["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[first], np.arange(n + 1)), pa.int32()), struct)
        return scores, spans


def seed_labels(feats: np.ndarray, rows: np.ndarray, toxic: np.ndarray, odds: float = 4.0, surprise: float = 24.0) -> np.ndarray:
    """Which tokens of toxic documents have a feature that is typical of toxic documents: more frequent
    there by ``odds``, and by a likelihood ratio that chance hardly gives to one of 100,000 features."""
    n = len(toxic)
    low = np.full(n, U64(2**64 - 1))
    whole = mix(feats[0].astype(U64) << U64(36) ^ feats[3].astype(U64) << U64(18) ^ feats[5].astype(U64))
    three = whole + U64(3) * np.append(whole[1:], whole[:1]) + U64(5) * np.append(whole[2:], whole[:2])[: len(whole)]
    np.minimum.at(low, rows, mix(three))
    family = np.unique(low, return_inverse=True)[1] * 2 + toxic.astype(np.int64)
    out = np.zeros(feats.shape[1], bool)
    n_toxic, n_clean = max(1, len(set(family[toxic > 0].tolist()))), max(1, len(set(family[toxic == 0].tolist())))
    for f in feats:
        pairs = np.unique(f.astype(np.int64) << 33 | family[rows])
        is_toxic, feature = pairs & 1, pairs >> 33
        bad, good = np.bincount(feature, is_toxic, 1 << BITS), np.bincount(feature, 1 - is_toxic, 1 << BITS)
        rate = np.maximum(bad + good, 1e-9) / (n_toxic + n_clean)
        ratio = 2 * (bad * np.log(np.maximum(bad, 1e-9) / (n_toxic * rate)) + good * np.log(np.maximum(good, 1e-9) / (n_clean * rate)))
        typical = (bad / n_toxic > odds * (good + 0.5) / n_clean) & (ratio > surprise)
        out |= typical[f]
    return out & (toxic[rows] > 0)


def fit(texts: list[bytes], toxic: np.ndarray, prior: float = 0.1, steps: int = 30, rate: float = 0.25) -> Field:
    """Adam on the conditional log likelihood of the labelled tokens; three of four texts fit the field, the rest the score."""
    field = Field(np.zeros((N_FEATURES, 1 << BITS)), -3.0, np.zeros((2, 2)), np.zeros(2), np.array([0.0, 0.0, 0.0, np.log(prior / (1 - prior))]))
    if len(texts) < 8 or len(set(toxic.tolist())) < 2:
        return field
    _, _, rows, feats = tokens(*T.joined(texts))
    part = np.arange(len(texts)) % 4 != 3
    keep = part[rows]
    y = seed_labels(feats[:, keep], rows[keep], np.where(part, toxic, 0)).astype(np.float64)
    fr, ff = rows[keep], feats[:, keep]
    parts = [field.weights, np.array([field.bias]), field.trans, field.start]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    begins = np.concatenate(([True], fr[1:] != fr[:-1]))
    yi = y.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (yi[:-1][~begins[1:]], yi[1:][~begins[1:]]), 1)
    seen_start = np.bincount(yi[begins], minlength=2)
    for step in range(1, steps + 1):
        field.bias = float(parts[1][0])
        p, alpha, beta, m, _ = field.chain(ff, fr)
        pair = np.empty((4, len(p) - 1))
        for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            pair[k] = alpha[i, :-1] * m[k, 1:] * beta[j, 1:]
        pair = (pair / pair.sum(axis=0))[:, ~begins[1:]].sum(axis=1).reshape(2, 2)
        d = y - p
        grads = [np.stack([np.bincount(f, d, 1 << BITS) for f in ff]) - 0.02 * parts[0], np.array([d.sum()]), seen - pair, seen_start - np.array([(1 - p[begins]).sum(), p[begins].sum()])]
        for x, g, (a, b) in zip(parts, grads, state):
            a += 0.1 * (g - a)
            b += 0.02 * (g * g - b)
            x += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.98**step)) + 1e-6)
    field.bias = float(parts[1][0])
    p = field.chain(feats, rows)[0]
    x = field.documents(p, rows, len(texts))[:, ~part]
    t = toxic[~part].astype(np.float64)
    weight = np.where(t > 0, prior / max(1, t.sum()), (1 - prior) / max(1, (1 - t).sum())) * len(t)
    w = np.array([0.5, 0.0, 0.5, np.log(prior / (1 - prior))])
    ridge = np.diag([0.05, 0.05, 0.05, 1e-3])
    for _ in range(25):  # Newton
        q = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        hess = (x * (weight * np.maximum(q * (1 - q), 1e-6))) @ x.T + ridge
        w = w + np.clip(np.linalg.solve(hess, x @ (weight * (t - q)) - ridge @ w), -2, 2)
    field.logit = w
    return field


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = T.SAMPLE_ROWS, most_bytes: int = T.SAMPLE_BYTES, seed: int = 0) -> Field:
    """The field fitted on a sample of labelled rows, bounded by ``rows`` of each class and ``most_bytes`` of text.

    The share of label 1 is that of all ``labels``.  Null ids and labels other than 0 and 1 are left out;
    of an id's labels the largest counts, of its texts the largest; a null text is empty.  Without both
    labels, or with fewer than 8 texts, the field gives every document the prior."""
    share = labels.filter(F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    return fit(*T.sample(docs, labels, label, rows, most_bytes, seed), prior=min(0.9, max(0.01, share if share is not None else 0.1)))


SPANS_DDL = "doc_id long, score double, spans array<struct<start:long,end:long>>"
SPANS = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score and toxic spans (code points, end exclusive) of each row's whole text.

    A null or empty text has no spans and the score of no toxic tokens; rows with equal or null ids
    are tagged each for itself; other columns are ignored; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # 10 MB, whatever the corpus
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return T.score_texts(rows, lambda raw, offsets: list(shared.value.score(raw, offsets)), SPANS_DDL, SPANS, ("doc_id",))
