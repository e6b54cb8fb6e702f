"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Candidates are runs of 6 or more characters of ``[A-Za-z0-9+/_.=-]`` that are no ordinary words (they
have a digit, a sign inside or a capital after their first letter) or follow ``:`` or ``=``, each
with ``SIDE`` bytes of its surroundings.  The network (numpy) looks up learned tables of ``TAPS``
character classes, max-pools over the candidate and over each side, and gives a probability.  A
candidate longer than ``CORE`` is read in overlapping patches; the likeliest counts.

It learns from labelled findings, the candidates that the fixed patterns confirm, but not to see the
patterns again: the keyword before a finding is overwritten with letters that mean nothing, so that
secrets under other names or none are found.  Each finding is also shown with its value drawn anew, in
its own surroundings and amid prose.  Against it stand all other candidates, ordinary long words, and
such words in a finding's place.  A start comes from a sample; passes over the examples of every text
go on from there.  Probabilities are calibrated on findings of all texts that these passes leave out, a third; each shape of candidate (hex digits; capitals and digits; others) has the highest
threshold that keeps ``RECALL`` of these.
"""

from __future__ import annotations

import copy
import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import training as T
from .arrays import SLICE_BYTES, characters_before, spans_of
from .common import bounded_batches, discard, frugal, store

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HINTS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
RECALL = 0.99
SIDE, CORE, TAPS, FILTERS = 24, 48, 4, 12
LEAST = 6
FRESH = (16, 40)


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


_LETTERS = _mask(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = _mask(b"0123456789")
_RUN = _LETTERS | _DIGITS | _mask(b"+/_.=-")
_HEXES = _DIGITS | _mask(b"abcdef")
_CAPITALS = _mask(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DRAWN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
SHAPES = ("hex", "capitals", "other")


def _classes() -> np.ndarray:
    """Character classes: digits; hex letters of either case, other letters of either case; signs; blanks; the rest."""
    out = np.full(256, 15, np.uint8)
    for i, chars in enumerate((b"0123456789", b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", b"+/", b"_-", b".", b"=:", b"\"'", b" \t", b"\n\r", b",;!?()", b"\x00")):
        out[list(chars)] = i
    return out


CLASS = _classes()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' findings, in code points."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def candidates(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, ends and rows of runs that may be secrets."""
    starts, ends, rows = spans_of(_RUN[raw], offsets)
    long = ends - starts >= LEAST
    starts, ends, rows = starts[long], ends[long], rows[long]
    if not len(starts):
        return starts, ends, rows

    def some(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether raw[a:b] has a byte of ``mask``."""
        sums = np.concatenate(([0], np.cumsum(mask[raw])))
        return sums[b] > sums[a]

    odd = some(_DIGITS, starts, ends) | some(_RUN & ~_LETTERS & ~_DIGITS, starts + 1, ends - 1) | some(_CAPITALS, starts + 1, ends)
    # a quote and blanks may stand between the sign and the run
    at, low = starts - 1, offsets[rows]
    for chars in (b"\"'", b" ", b" "):
        at = np.where((at >= low) & _mask(chars)[raw[np.maximum(at, 0)]], at - 1, at)
    odd |= (at >= low) & _mask(b":=")[raw[np.maximum(at, 0)]]
    return starts[odd], ends[odd], rows[odd]


def shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each run its place in SHAPES."""
    other = lambda mask: (lambda sums: sums[ends] > sums[starts])(np.concatenate(([0], np.cumsum(~mask[raw]))))
    return np.where(~other(_HEXES), 0, np.where(~other(_CAPITALS | _DIGITS), 1, 2))


def long_words(raw: np.ndarray, offsets: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of LEAST or more that are no candidates: what a secret must be told from."""
    starts, ends, rows = spans_of(_RUN[raw], offsets)
    ok = (ends - starts >= LEAST) & ~np.isin(starts, taken)
    return starts[ok], ends[ok], rows[ok]


def windows(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, at): where each candidate's patches begin among all, and the starts of their CORE bytes.

    A candidate of CORE bytes or fewer is one patch; a longer one has a patch every CORE / 2 bytes and
    one that ends with it."""
    n = 1 + -(-np.maximum(ends - starts - CORE, 0) // (CORE // 2))
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(starts)), n)
    nth = np.arange(len(owner)) - first[owner]
    return first, np.maximum(np.minimum(starts[owner] + nth * (CORE // 2), ends[owner] - CORE), starts[owner])


def patches(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, insides: np.ndarray | None = None) -> np.ndarray:
    """Character classes of SIDE bytes before, the first and last CORE / 2 inside, SIDE bytes after; zeros beyond the row.

    ``insides``: where the patch's CORE bytes start in a longer candidate."""
    padded = np.concatenate((raw, np.zeros(1, np.uint8)))
    low, high = offsets[rows][:, None], offsets[rows + 1][:, None]
    left = starts[:, None] + np.arange(-SIDE, 0)
    begin = starts if insides is None else insides
    head = begin[:, None] + np.arange(CORE // 2)
    tail = np.minimum(ends, begin + CORE)[:, None] + np.arange(-(CORE // 2), 0)
    right = ends[:, None] + np.arange(SIDE)
    out = []
    for at, a, b in ((left, low, high), (head, starts[:, None], ends[:, None]), (tail, starts[:, None], ends[:, None]), (right, low, high)):
        out.append(np.where((at >= a) & (at < b), padded[np.clip(at, 0, len(raw))], 0))
    return CLASS[np.concatenate(out, axis=1)]


@dataclass
class Scanner:
    taps: np.ndarray
    bias: np.ndarray
    w: np.ndarray
    b: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, float, float] = (1.1, 1.1, 1.1)
    held_out: tuple[float, float] = (0.0, 0.0)

    @staticmethod
    def fresh(seed: int) -> Scanner:
        rng = np.random.default_rng(seed)
        return Scanner((rng.standard_normal((TAPS, 16, FILTERS)) * 0.3).astype(np.float32), np.zeros(FILTERS, np.float32), (rng.standard_normal(3 * FILTERS) * 0.3).astype(np.float32), np.zeros(1, np.float32))

    def pooled(self, x: np.ndarray):
        n = x.shape[1] - TAPS + 1
        z = sum(np.take(self.taps[k], x[:, k : k + n], axis=0) for k in range(TAPS)) + self.bias
        bounds = ((0, SIDE), (SIDE, SIDE + CORE - TAPS + 1), (SIDE + CORE - TAPS + 1, n))
        parts, places = [], []
        for i, (a, c) in enumerate(bounds):
            at = z[:, a:c].argmax(axis=1)
            places.append(at + a)
            parts.append(np.maximum(np.take_along_axis(z[:, a:c], at[:, None], axis=1)[:, 0], 0))
        return np.concatenate(parts, axis=1), places

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for a in range(0, len(x), 2048):
            out[a : a + 2048] = self.pooled(x[a : a + 2048])[0] @ self.w + self.b
        return out

    def judge(self, raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The logit of each candidate's likeliest patch; patches are made 8192 at a time."""
        first, insides = windows(starts, ends)
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(first, len(insides))))
        z = np.empty(len(insides))
        for a in range(0, len(insides), 8192):
            o = owner[a : a + 8192]
            z[a : a + 8192] = self.logits(patches(raw, offsets, starts[o], ends[o], rows[o], insides[a : a + 8192]))
        return np.maximum.reduceat(z, first) if len(first) else z

    def accepted(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Which candidates with probabilities ``p`` are findings."""
        return p >= np.array(self.thresholds)[shapes(raw, starts, ends)]

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = self.scale[0] * logits + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def likeliest(net: Scanner, raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, i: int, insides: np.ndarray) -> int:
    """Which of candidate i's patches has the highest logit."""
    same = np.full(len(insides), i)
    return int(np.concatenate([net.logits(patches(raw, offsets, starts[o], ends[o], rows[o], insides[a : a + 8192])) for a in range(0, len(same), 8192) for o in (same[a : a + 8192],)]).argmax())


def _findings(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, keyword's start, keyword's end) of the patterns' values in bytes; no keyword: (0, 0)."""
    own = text.decode()
    at = lambda i: len(own[:i].encode())
    out = [(at(m.start(2)), at(m.end(2)), at(m.start(1)), at(m.end(1))) for m in ASSIGN.finditer(own) if len(m[2]) >= 6]
    return out + [(at(a), at(b), 0, 0) for a, kind, b in base_spans(own) if kind]


@dataclass
class Examples:
    """Candidates to learn from, each in a text of its own: texts, places, labels, source texts, and what is
    shown (0 a finding as it is but for its keyword, 1 a finding drawn anew, 2 no finding)."""

    texts: list[bytes]
    starts: list[int]
    sizes: list[int]
    labels: list[int]
    sources: list[int]
    views: list[int]

    def add(self, left: bytes, value: bytes, right: bytes, label: int, source: int, view: int) -> None:
        for to, x in zip((self.texts, self.starts, self.sizes, self.labels, self.sources, self.views), (left + value + right, len(left), len(value), label, source, view)):
            to.append(x)  # type: ignore[arg-type]


def examples(texts: list[bytes], rng: np.random.Generator, words_each: int = 4, words_more: int = 200) -> Examples:
    """Every candidate of the texts, findings drawn anew, and ``words_each`` ordinary words a candidate and ``words_more`` besides."""
    out = Examples([], [], [], [], [], [])
    raw, offsets = T.joined(texts)
    starts, ends, rows = candidates(raw, offsets)
    ws, we, wr = long_words(raw, offsets, starts)
    letters = lambda n, chars: bytes(rng.choice(list(chars), n).tolist())
    for r in np.unique(rows).tolist():
        t, mine = texts[r], np.flatnonzero(rows == r)
        low = t.lower()
        # hex findings that matter are inside a candidate
        found = _findings(t) if b"akia" in low or any(h in low for h in HINTS) or (ends[mine] - starts[mine]).max() >= 24 else []
        hidden = bytearray(t)
        for _, _, a, b in found:
            hidden[a:b] = letters(b - a, b"abcdefghijklmnopqrstuvwxyz")
        words = np.flatnonzero(wr == r)
        for s, e in zip((starts[mine] - offsets[r]).tolist(), (ends[mine] - offsets[r]).tolist()):
            own = [(max(a, s), min(b, e)) for a, b, _, _ in found if a < e and b > s]
            left, right = bytes(hidden[max(0, s - SIDE) : s]), bytes(hidden[e : e + SIDE])
            if not own:
                out.add(left, bytes(hidden[s:e]), right, 0, r, 2)
                continue
            a, b = own[0]
            anew = lambda: bytes(hidden[s:a]) + letters(int(rng.integers(FRESH[0], FRESH[1] + 1)), _DRAWN) + bytes(hidden[b:e])  # noqa: B023, E731
            out.add(left, bytes(hidden[s:e]), right, 1, r, 0)
            out.add(left, anew(), right, 1, r, 1)
            if len(words):
                w = int(rng.choice(words))
                x, y = int(ws[w] - offsets[r]), int(we[w] - offsets[r])
                out.add(t[max(0, x - SIDE) : x], anew(), t[y : y + SIDE], 1, r, 1)
                out.add(left, t[x:y], right, 0, r, 2)
    for w in rng.permutation(len(ws))[: words_each * len(starts) + words_more].tolist():
        r = int(wr[w])
        x, y = int(ws[w] - offsets[r]), int(we[w] - offsets[r])
        out.add(texts[r][max(0, x - SIDE) : x], texts[r][x:y], texts[r][y : y + SIDE], 0, r, 2)
    return out


class Adam:
    """Steps on the log loss of ``net``, which they change."""

    def __init__(self, net: Scanner, rate: float = 0.01) -> None:
        self.net, self.rate, self.parts = net, rate, [net.taps, net.bias, net.w, net.b]
        self.state, self.t = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parts], 0

    def step(self, shown: tuple[np.ndarray, ...], mine: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One step on the examples ``mine`` of ``shown``: raw, offsets, starts, ends, rows, first patches, all patches' starts, numbers of patches."""
        net, (raw, offsets, starts, ends, rows, first, insides, many) = self.net, shown
        # each candidate's likeliest patch, as when scanning
        at = first[mine].copy()
        for i in np.flatnonzero(many[mine] > 1).tolist():
            c = np.arange(first[mine[i]], first[mine[i]] + many[mine[i]])
            at[i] = c[likeliest(net, raw, offsets, starts, ends, rows, mine[i], insides[c])]
        xs = patches(raw, offsets, starts[mine], ends[mine], rows[mine], insides[at])
        act, places = net.pooled(xs)
        p = 1 / (1 + np.exp(-np.clip(act @ net.w + net.b, -30, 30)))
        g = ((p - y) * weight / len(mine)).astype(np.float32)
        g_act = g[:, None] * net.w[None, :] * (act > 0)
        g_taps, g_bias = np.zeros_like(net.taps), np.zeros_like(net.bias)
        f = np.arange(FILTERS)[None, :]
        for i, at in enumerate(places):
            part = g_act[:, i * FILTERS : (i + 1) * FILTERS]
            g_bias += part.sum(0)
            for k in range(TAPS):
                cls = xs[np.arange(len(xs))[:, None], at + k].astype(np.int64)
                g_taps[k] += np.bincount((cls * FILTERS + f).ravel(), part.ravel(), 16 * FILTERS).reshape(16, FILTERS)
        self.t += 1
        for q, grad, (m, v) in zip(self.parts, (g_taps, g_bias, act.T @ g, np.array([g.sum()])), self.state):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            q -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def fit(texts: list[bytes], seed: int = 0, epochs: int = 12, recall: float = RECALL) -> Scanner:
    """Adam on the log loss; every third text is kept for calibration and the thresholds.

    Without findings to learn from the scanner adds nothing."""
    net, rng = Scanner.fresh(seed), np.random.default_rng(seed)
    shown = examples(texts, rng) if texts else Examples([], [], [], [], [], [])
    if not shown.texts:
        return net
    raw, offsets = T.joined(shown.texts)
    all_rows = np.arange(len(shown.texts))
    all_starts = offsets[:-1] + np.array(shown.starts)
    all_ends = all_starts + np.array(shown.sizes)
    first, insides = windows(all_starts, all_ends)
    many = np.diff(np.append(first, len(insides)))
    y, views = np.array(shown.labels, np.float32), np.array(shown.views)
    hold = np.array(shown.sources) % 3 == 2
    if y[~hold].sum() < 5 or (views[hold] == 0).sum() < 3:
        return net
    train, yt = np.flatnonzero(~hold), y[~hold]
    weight = np.where(yt > 0, 0.5 / yt.sum(), 0.5 / max(1, (1 - yt).sum())) * len(yt)
    adam = Adam(net)
    for _ in range(epochs):
        for ids in np.array_split(rng.permutation(len(train)), max(1, len(train) // 64)):
            adam.step((raw, offsets, all_starts, all_ends, all_rows, first, insides, many), train[ids], yt[ids], weight[ids])
    z, w = net.judge(raw, offsets, all_starts[hold], all_ends[hold], all_rows[hold]), np.array([1.0, 0.0])
    real, yh = views[hold] != 1, y[hold]  # calibrated on findings as they are
    for _ in range(20):  # Platt's scaling, by Newton
        q = 1 / (1 + np.exp(-np.clip(w[0] * z[real] + w[1], -30, 30)))
        a = np.stack((z[real], np.ones(real.sum())))
        hess = (a * np.maximum(q * (1 - q), 1e-5)) @ a.T + np.diag([1e-2, 1e-3])
        w += np.clip(np.linalg.solve(hess, a @ (yh[real] - q) - np.array([1e-2, 1e-3]) * w), -1, 1)
    net.scale = (max(0.05, float(w[0])), float(w[1]))
    p, shape = net.probabilities(z), shapes(raw, all_starts[hold], all_ends[hold])

    def threshold(of: np.ndarray) -> float:
        good = np.sort(p[of])
        return float(good[int((1 - recall) * len(good))])

    # a shape without findings of its own takes those drawn anew, and else all findings
    found, drawn = (yh > 0) & real, (yh > 0) & ~real
    net.thresholds = tuple(threshold(next(m for m in (found & (shape == k), drawn & (shape == k), found) if m.sum() >= 3 or m is found)) for k in range(len(SHAPES)))
    said = net.accepted(raw, all_starts[hold], all_ends[hold], p)
    net.held_out = (float(said[found].mean()), float(found[said & real].mean()) if (said & real).any() else 0.0)
    return net


#: The bound of the start: different texts, bytes of text in all, bytes of the longest text.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_LONGEST = 2500, 12_000_000, 100_000


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, longest: int = SAMPLE_LONGEST) -> list[bytes]:
    """Different texts to fit on: up to ``rows``, half of them with findings as SQL sees them, by a hash of the text.

    Hashes and sizes choose first; only chosen texts, ``most_bytes`` of them at most and none above
    ``longest`` bytes, come to the driver.  The bounds are those of the start; ``train`` goes on over all rows, and scans read all texts whole.
    """
    hint = F.col("text").rlike(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i)(passw(or)?d|secret|token|api_?key)[\"']? *[:=]")
    size, order = F.octet_length("text").alias("n"), F.xxhash64("text").alias("o")
    short = docs.filter(F.octet_length("text") <= longest)
    marks = store(short.select(hint.alias("h"), order, size))
    halves = [marks.filter(c).groupBy("o").agg(F.max("n").alias("n")).orderBy("o").limit(rows // 2) for c in ("h", "NOT h")]
    chosen, used = [], 0
    for o, n in sorted(tuple(r) for r in halves[0].unionByName(halves[1]).collect()):  # at most ``rows`` pairs of numbers
        if used + n <= most_bytes:
            chosen.append((o,))
            used += n
    discard(marks)
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "o long"))
    texts = short.select(order, "text").join(wanted, "o").groupBy("o").agg(F.max("text").alias("text")).orderBy("o")
    return [text.encode() for text in texts.toArrow().column("text").to_pylist()]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])
FOUND = pa.list_(SPAN)
FOUND_DDL = "array<struct<kind:string,start:long,end:long,probability:double>>"


def find(raw: np.ndarray, offsets: np.ndarray, net: Scanner) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, probability) of each row's findings, in order; base ones have probability 1."""
    n = len(offsets) - 1
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(n)]
    hs, he, hr = spans_of(_HEXES[raw], offsets)
    look = np.zeros(n, bool)
    look[hr[he - hs >= 24]] = True
    texts: dict[int, str] = {}
    for i in range(n):
        part = raw[offsets[i] : offsets[i + 1]].tobytes()
        low = part.lower()
        if look[i] or b"AKIA" in part or any(h in low for h in HINTS):
            texts[i] = part.decode()
            out[i] = [(a, k, b, 1.0) for a, k, b in base_spans(texts[i])]
    starts, ends, rows = candidates(raw, offsets)
    if len(starts):
        p = net.probabilities(net.judge(raw, offsets, starts, ends, rows))
        chars = characters_before(raw)
        for j in np.flatnonzero(net.accepted(raw, starts, ends, p)).tolist():
            r = int(rows[j])
            a, b = int(chars[starts[j]] - chars[offsets[r]]), int(chars[ends[j]] - chars[offsets[r]])
            if not any(a < y and b > x for x, k, y, _ in out[r] if k < 3):
                out[r].append((a, 3, b, float(p[j])))
    return [sorted(x) for x in out]


def spans_text(found: list[tuple[int, int, int, float]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found)


SCAN_DDL = f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found {FOUND_DDL}"
SCAN = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("found", FOUND)])


def scan(docs: DataFrame, net: Scanner) -> DataFrame:
    """Findings of each row's whole text: counts of the patterns', a digest of these, and all spans.

    A null text is empty; rows with equal or null ids are scanned each for itself; other columns are
    ignored; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few kB

    def score(raw: np.ndarray, offsets: np.ndarray) -> list:
        found = find(raw, offsets, shared.value)
        base = [[s for s in f if s[1] < 3] for f in found]
        counts = [[sum(s[1] == k for s in f) for f in base] for k in range(3)]
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(spans_text(f).encode()).hexdigest() for f in base], pa.string()), pa.array([spans_text(f) for f in found], pa.string()), pa.array([[{"kind": KINDS[k], "start": a, "end": b, "probability": p} for a, k, b, p in f] for f in found], FOUND)]

    return T.score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), score, SCAN_DDL, SCAN, ("doc_id",))


def redact(docs: DataFrame, net: Scanner, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mask``; all other columns and null texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def clean(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            column = batch.column(at)
            texts = column.to_pylist()
            raws = [(t or "").encode() for t in texts]
            a, out = 0, []
            while a < len(raws):
                b, used = a, 0
                while b < len(raws) and (b == a or used + len(raws[b]) <= SLICE_BYTES):
                    used += len(raws[b])
                    b += 1
                for t, f in zip(texts[a:b], find(*T.joined(raws[a:b]), shared.value)):
                    end = 0
                    if t is not None and f:
                        cut = []
                        for x, _, y, _ in f:
                            if x >= end:
                                cut += [t[end:x], mask]
                            end = max(end, y)
                        t = "".join([*cut, t[end:]])
                    out.append(t)
                a = b
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, column.type))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(frugal(clean), docs.schema)


#: Passes over all examples after a start on a sample, and without one; rows of a step; steps of a logit in the histogram.
ROUNDS, ROUNDS_FRESH, STEP_ROWS, GRID = 2, 12, 256, 256
EXAMPLE_DDL = "text binary, start int, size int, y int, view int, hold boolean"
_EXAMPLE = pa.schema([("text", pa.binary()), ("start", pa.int32()), ("size", pa.int32()), ("y", pa.int32()), ("view", pa.int32()), ("hold", pa.bool_())])


def all_examples(docs: DataFrame, seed: int = 0) -> DataFrame:
    """What every text shows; ``hold`` is a third of the texts, by a hash, so that copies are on one side.

    All candidates are there.  Ordinary words are never judged by a scan and serve as contrast only: a text
    draws one for each of its candidates and one more.  What is drawn depends on the text and the seed alone."""

    def run(batches):
        for batch in batches:
            for t in batch.column(0):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                h = zlib.crc32(raw, seed)
                x = examples([raw], np.random.default_rng(h), 1, 1) if len(raw) >= LEAST else None
                for a in range(0, len(x.texts) if x else 0, 4096):
                    n = slice(a, a + 4096)
                    columns = x.texts[n], x.starts[n], x.sizes[n], x.labels[n], x.views[n], [h % 3 == 2] * len(x.texts[n])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EXAMPLE)], schema=_EXAMPLE)

    def packed(batches):
        """Batches of some 4,096 rows, or 1 MB, instead of one for each text."""
        held, rows, size = [], 0, 0
        for b in run(batches):
            held.append(b)
            rows, size = rows + b.num_rows, size + b.nbytes
            if rows >= 4096 or size >= 1 << 20:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows, size = [], 0, 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    bounded_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(frugal(packed), EXAMPLE_DDL)


def _shown(batch: pa.RecordBatch) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The examples of a batch as ``Adam.step`` takes them, and their labels."""
    raw, offsets = T.joined(batch.column("text").to_pylist())
    starts = offsets[:-1] + batch.column("start").to_numpy()
    ends = starts + batch.column("size").to_numpy()
    first, insides = windows(starts, ends)
    return (raw, offsets, starts, ends, np.arange(len(starts)), first, insides, np.diff(np.append(first, len(insides)))), batch.column("y").to_numpy().astype(np.float32)


def descend(shown: DataFrame, net: Scanner, found: int, others: int, seed: int, rate: float) -> Scanner:
    """``net`` after one pass over the examples that are not held out: every task takes its own steps from
    ``net``, and the results are averaged, weighted by rows."""
    spark = shown.sparkSession
    shared, sizes = spark.sparkContext.broadcast(net), [p.size for p in (net.taps, net.bias, net.w, net.b)]
    each = np.array([0.5 / max(1, others), 0.5 / max(1, found)]) * (found + others)

    def run(batches):
        mine, rng, rows = copy.deepcopy(shared.value), np.random.default_rng(seed), 0
        adam = Adam(mine, rate)
        for batch in batches:
            if batch.num_rows:
                x, y = _shown(batch)
                for ids in np.array_split(rng.permutation(len(y)), max(1, len(y) // STEP_ROWS)):
                    adam.step(x, ids, y[ids], each[y[ids].astype(int)])
                rows += len(y)
        if rows:
            flat = np.concatenate([p.ravel() for p in adam.parts]).astype(np.float64) * rows
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(flat)), pa.int32()), "v": flat, "n": pa.array(np.full(len(flat), rows), pa.int64())})

    sums = shown.filter("NOT hold").mapInArrow(frugal(run), "i int, v double, n long").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).orderBy("i").toArrow()  # one row for each number of the network
    taps, bias, w, b = np.split(sums.column("v").to_numpy().astype(np.float32), np.cumsum(sizes)[:-1])
    return Scanner(taps.reshape(net.taps.shape), bias, w, b)


def calibrate(shown: DataFrame, net: Scanner, recall: float = RECALL) -> Scanner:
    """Scales and thresholds of ``net`` from a histogram of the logits of all held-out examples.

    A threshold is the lower edge of a cell, so no less than ``recall`` of the findings are kept."""
    shared = shown.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                (raw, offsets, starts, ends, rows, *_), y = _shown(batch)
                cell = np.floor(np.clip(shared.value.judge(raw, offsets, starts, ends, rows), -100, 100) * GRID)
                key = np.stack((cell, shapes(raw, starts, ends), y, batch.column("view").to_numpy())).astype(np.int32)
                key, n = np.unique(key, axis=1, return_counts=True)
                yield pa.RecordBatch.from_pydict({**{c: k for c, k in zip(("cell", "shape", "y", "view"), key)}, "n": pa.array(n, pa.int64())})

    cells = shown.filter("hold").mapInArrow(frugal(run), "cell int, shape int, y int, view int, n long")
    cells = cells.groupBy("cell", "shape", "y", "view").agg(F.sum("n").alias("n")).orderBy("cell", "shape", "y", "view").toArrow()  # bounded by the cells
    cell, shape, y, view, n = (cells.column(c).to_numpy() for c in ("cell", "shape", "y", "view", "n"))
    real, found, drawn = view != 1, (y > 0) & (view != 1), (y > 0) & (view == 1)
    z, w, share = (cell + 0.5) / GRID, np.array([1.0, 0.0]), n / max(1, n[real].sum()) * min(n[real].sum(), 100_000)
    for _ in range(40):  # Platt's scaling, by Newton
        q = 1 / (1 + np.exp(-np.clip(w[0] * z[real] + w[1], -30, 30)))
        a = np.stack((z[real], np.ones(real.sum())))
        hess = (a * (share[real] * np.maximum(q * (1 - q), 1e-5))) @ a.T + np.diag([1e-2, 1e-3])
        w += np.clip(np.linalg.solve(hess, a @ (share[real] * (y[real] - q)) - np.array([1e-2, 1e-3]) * w), -1, 1)
    net.scale = (max(0.05, float(w[0])), float(w[1]))

    def edge(of: np.ndarray) -> int:
        upto = np.cumsum(n[of])
        return int(cell[of][np.searchsorted(upto, int((1 - recall) * upto[-1]), side="right")])

    # a shape without findings of its own takes those drawn anew, and else all findings
    edges = np.array([edge(next(m for m in (found & (shape == k), drawn & (shape == k), found) if n[m].sum() >= 3 or m is found)) for k in range(len(SHAPES))])
    net.thresholds = tuple(net.probabilities(edges / GRID).tolist())
    said = cell >= edges[shape]
    net.held_out = (float(n[said & found].sum() / n[found].sum()), float(n[said & found].sum() / max(1, n[said & real].sum())))
    return net


def train(docs: DataFrame, seed: int = 0, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, longest: int = SAMPLE_LONGEST) -> Scanner:
    """The scanner fitted on all of ``docs``: the candidates of every text are learned from or held out.

    A sample (``rows``, ``most_bytes`` and ``longest`` as in ``sample``) only gives the network that the passes
    over all rows start from; counts, scales and thresholds are those of all rows.  Without findings to
    learn from the scanner adds no spans to the patterns'."""
    net = fit(sample(docs, rows, most_bytes, longest), seed)
    shown = store(all_examples(docs, seed))
    try:
        found, others, kept = shown.agg(*(F.count_if(F.expr(c)) for c in ("NOT hold AND y = 1", "NOT hold AND y = 0", "hold AND y = 1 AND view = 0"))).first()
        if found < 5 or kept < 3:
            return Scanner.fresh(seed)
        fresh = max(net.thresholds) > 1
        for i in range(ROUNDS_FRESH if fresh else ROUNDS):
            net = descend(shown, net, found, others, seed + i, 0.01 if fresh else 0.002)
        return calibrate(shown, net)
    finally:
        discard(shown)
