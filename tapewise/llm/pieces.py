"""SentencePiece encoding with seeded merge-dropout, and decoding without loss.

A model's merge vocabulary (byte fallback included) is read from its file; nothing is trained.  White
space is not normalised: a space is the piece's mark, every other character that has no piece, the
mark itself included, goes to bytes.  A unit is a run of spaces and the characters up to the next
space; no piece crosses units.

Agenda: of all neighbouring pieces whose concatenation is a piece, the one with the best score, the
leftmost of equals, is merged next.  A candidate merge is skipped for good if the keyed hash of (seed,
document, the unit's number in it, unit, place, the two pieces) falls below ``dropout``, so that each
occurrence of a unit has a draw of its own for each candidate.  The agenda without dropout and its
candidates are looked up for units met before: an occurrence that skips none of these has its pieces,
every other one is worked out anew.
Short units run through the agenda side by side in arrays, long ones each with a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, characters_before, mix, slices, string_buffers, word_hashes
from .common import bounded_batches, frugal

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
MARK = "▁"
LONGEST = 64
SLICE = 1 << 20  # bytes of text encoded at once: arrays over characters take some 100 times as much
NEVER = np.int32(2**31 - 1)


@dataclass
class Vocabulary:
    """Pieces as bytes (marks as spaces), places of single characters, and all merges by their two parts."""

    pieces: list[bytes]
    single: np.ndarray
    byte_ids: np.ndarray
    keys: np.ndarray
    merged: np.ndarray
    rank: np.ndarray

    def __post_init__(self) -> None:
        slot = (self.keys * 0x2545F4914F6CDD1D >> 20) & ((1 << 19) - 1)
        self.table, self.crowded = np.zeros(1 << 19, np.int32), np.bincount(slot, minlength=1 << 19) > 1
        self.table[slot] = np.arange(len(self.keys), dtype=np.int32)

    @property
    def size(self) -> int:
        return len(self.pieces)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b make together, or -1."""
        key = a.astype(np.int64) << 32 | b
        slot = (key * 0x2545F4914F6CDD1D >> 20) & (len(self.table) - 1)
        at = self.table[slot]
        out = np.where(self.keys[at] == key, self.merged[at], -1)
        more = np.flatnonzero((self.keys[at] != key) & self.crowded[slot])
        if len(more):  # slots that several merges share
            k = key[more]
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            out[more] = np.where(self.keys[at] == k, self.merged[at], -1)
        return out


def load(model_file: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
    byte_ids, ids, pieces = np.zeros(256, np.int32), {}, []
    for i, name in enumerate(names):
        if sp.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            pieces.append(bytes([int(name[3:5], 16)]))
        else:
            pieces.append(b"" if special[i] else name.replace(MARK, " ").encode())
            if not special[i]:
                if MARK in name.lstrip(MARK):
                    raise ValueError(f"piece {name!r} crosses words")
                ids[name] = i
    # characters without a piece stand as n + code point: no merge has them
    single = n + np.arange(0x110000, dtype=np.int32)
    for name, i in ids.items():
        if len(name) == 1:
            single[ord(name) if name != MARK else 32] = i
    scores = np.array([sp.get_score(i) for i in range(n)])
    found = sorted((ids[name[:k]] << 32 | ids[name[k:]], i) for name, i in ids.items() for k in range(1, len(name)) if name[:k] in ids and name[k:] in ids)
    rank = np.empty(n, np.int32)
    rank[np.argsort(-scores, kind="stable")] = np.arange(n, dtype=np.int32)
    return Vocabulary(pieces, single, byte_ids, np.array([k for k, _ in found], np.int64), np.array([i for _, i in found], np.int32), rank)


def _named(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for the merge of a and b at ``place``."""
    return a.astype(U64) << U64(40) ^ b.astype(U64) << U64(16) ^ place.astype(U64)


def _drawn(unit: np.ndarray, named: np.ndarray, limit: int) -> np.ndarray:
    """False where the keyed hash skips a merge."""
    return (mix(unit + named, 11) >> U64(11)) >= U64(limit)


def _kept(a: np.ndarray, b: np.ndarray, place: np.ndarray, unit: np.ndarray, limit: int) -> np.ndarray:
    """False where the keyed hash skips the merge of a and b at ``place``."""
    return _drawn(unit, _named(a, b, place), limit) if limit else np.ones(len(a), bool)


def _side_by_side(vocab: Vocabulary, ids: np.ndarray, lengths: np.ndarray, units: np.ndarray, limit: int, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs the agenda of many units in step: (pieces of all units, their numbers); ids has shape (units, width).

    ``seen`` is given the rows and the names of all candidates."""
    n, width = ids.shape
    ids = ids.ravel().copy()
    after = np.tile(np.arange(1, width + 1, dtype=np.int32), n)
    before = np.tile(np.arange(-1, width - 1, dtype=np.int32), n)
    alive = (np.arange(width)[None, :] < lengths[:, None]).ravel()
    new, best = np.full(n * width, -1, np.int32), np.full(n * width, NEVER, np.int32)

    def offer(rows: np.ndarray, at: np.ndarray) -> None:
        """Candidates of the pieces at ``at`` and those after them."""
        here = rows * width + at
        a, b = ids[here], ids[rows * width + after[here]]
        m = vocab.merge(a, b)
        ok = np.flatnonzero(m >= 0)
        if seen is not None:
            seen.append((rows[ok], _named(a[ok], b[ok], at[ok])))
        ok = ok[_kept(a[ok], b[ok], at[ok], units[rows[ok]], limit)]
        best[here] = NEVER
        new[here[ok]] = m[ok]
        best[here[ok]] = vocab.rank[m[ok]]

    offer(*np.nonzero(np.arange(width)[None, :] < (lengths - 1)[:, None]))
    live, counts = np.arange(n), lengths.copy()
    while len(live):
        j = best.reshape(n, width)[live].argmin(axis=1)
        here = live * width + j
        go = best[here] != NEVER
        live, j, here = live[go], j[go], here[go]
        gone = live * width + after[here]
        follows = after[gone]
        ids[here], after[here] = new[here], follows
        best[here] = best[gone] = NEVER
        alive[gone] = False
        counts[live] -= 1
        inner = np.flatnonzero(follows < lengths[live])
        before[live[inner] * width + follows[inner]] = j[inner]
        left = np.flatnonzero(before[here] >= 0)
        offer(np.concatenate((live[left], live[inner])), np.concatenate((before[here[left]].astype(np.int64), j[inner])))
    return ids[alive], counts


def _one(vocab: Vocabulary, ids: list[int], unit: np.uint64, limit: int) -> list[int]:
    """The same agenda for one unit of any length, with a heap and neighbour links."""
    n = len(ids)
    after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

    def offer(lefts: list[int]) -> None:
        a, b = np.array([ids[i] for i in lefts], np.int32), np.array([ids[after[i]] for i in lefts], np.int32)
        m = vocab.merge(a, b)
        ok = (m >= 0) & _kept(a, b, np.array(lefts), np.full(len(lefts), unit, U64), limit)
        for i, x, y, z in zip(np.array(lefts)[ok].tolist(), m[ok].tolist(), a[ok].tolist(), b[ok].tolist()):
            heapq.heappush(heap, (int(vocab.rank[x]), i, x, y, z))

    with np.errstate(over="ignore"):
        offer(list(range(n - 1)))
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i] if ids[i] == y else n
            if j >= n or ids[j] != z:
                continue
            ids[i], ids[j] = x, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            around = ([before[i]] if before[i] >= 0 else []) + ([i] if after[i] < n else [])
            if around:
                offer(around)
    return [x for x in ids if x >= 0]


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all of starts[i] ... starts[i] + lengths[i] - 1, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Memory:
    """Pieces without dropout, and all candidates on the way, of short units that a task has met before; it starts anew beyond ``most`` units."""

    def __init__(self, most: int = 1 << 18) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.units, self.flat, self.names = np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, U64)
        self.begins, self.counts, self.firsts, self.offers = (np.zeros(0, np.int64) for _ in range(4))

    def look_up(self, vocab: Vocabulary, singles: np.ndarray, starts: np.ndarray, lengths: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Places in this memory of sorted distinct units; new ones are worked out and kept."""
        if len(self.units) + len(units) > self.most:
            self.clear()
        at = np.searchsorted(self.units, units)
        known = np.zeros(len(units), bool)
        inside = at < len(self.units)
        known[inside] = self.units[at[inside]] == units[inside]
        new = np.flatnonzero(~known)
        if not len(new):
            return at
        seen: list = []
        flat, counts = _units(vocab, singles, starts[new], lengths[new], units[new], 0, seen)
        owner = np.concatenate([np.zeros(0, np.int64), *(o for o, _ in seen)])
        names = np.concatenate([np.zeros(0, U64), *(x for _, x in seen)])[np.argsort(owner, kind="stable")]
        offers = np.bincount(owner, minlength=len(new)).astype(np.int64)
        begins, firsts = np.cumsum(counts) - counts + len(self.flat), np.cumsum(offers) - offers + len(self.names)
        kept = (self.units, units[new]), (self.begins, begins), (self.counts, counts), (self.firsts, firsts), (self.offers, offers)
        self.units, self.begins, self.counts, self.firsts, self.offers = (np.insert(x, at[new], y) for x, y in kept)
        self.flat, self.names = np.concatenate((self.flat, flat)), np.concatenate((self.names, names))
        return np.searchsorted(self.units, units)

    def skips(self, at: np.ndarray, drawn: np.ndarray, limit: int) -> np.ndarray:
        """Which occurrences (places ``at``, with their own hashes ``drawn``) skip a candidate of the agenda without dropout."""
        out = np.zeros(len(at), bool)
        for a in range(0, len(at), 1 << 16):
            some = at[a : a + (1 << 16)]
            n = self.offers[some]
            who = np.repeat(np.arange(a, a + len(some)), n)
            out[who[~_drawn(drawn[who], self.names[_ragged(self.firsts[some], n)], limit)]] = True
        return out


def encode(raw: np.ndarray, offsets: np.ndarray, keys: np.ndarray, vocab: Vocabulary, dropout: float = DROPOUT, seed: int = 0, memory: Memory | None = None, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of all rows; ``keys`` (one a row) and ``seed`` choose what is skipped.

    Units are told apart by a 64-bit hash of their characters, chosen by ``salt``.

    An empty row has no pieces."""
    n = len(offsets) - 1
    chars = characters_before(raw)[offsets]
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    filled = np.flatnonzero(np.diff(chars) > 0)
    points = np.insert(points, chars[filled], 32)  # the mark before a text
    first = chars[:-1] + np.cumsum(np.diff(chars) > 0) - (np.diff(chars) > 0)
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    blank = points == 32
    begin = blank.copy()
    begin[1:] &= ~blank[:-1]
    begin[first[filled]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(points))
    doc = np.searchsorted(first[filled], starts, "right") - 1
    row = filled[doc]
    nth = np.arange(len(starts)) - np.searchsorted(starts, first[filled])[doc]
    limit = int(dropout * 2**53)
    with np.errstate(over="ignore"):
        unit = word_hashes(points.view(np.uint8), 4 * starts, 4 * ends, salt)
        lengths, singles = ends - starts, vocab.single[points]
        short = np.flatnonzero(lengths <= LONGEST)
        _, first_of, inverse = np.unique(unit[short], return_index=True, return_inverse=True)
        first_of = short[first_of]
        memory = memory or Memory()
        at = memory.look_up(vocab, singles, starts[first_of], lengths[first_of], unit[first_of])[inverse]
        drawn = mix(unit + mix(keys[row] + mix(nth.astype(U64) + U64(seed), 21), 22) + mix(np.array([seed], U64), 23)[0], 24)
        again = np.ones(len(starts), bool)
        again[short] = memory.skips(at, drawn[short], limit) if limit else False
        same, anew = np.flatnonzero(~again[short]), np.flatnonzero(again)
        flat, counts_anew = _units(vocab, singles, starts[anew], lengths[anew], drawn[anew], limit)
    counts = np.zeros(len(starts), np.int64)
    counts[short[same]], counts[anew] = memory.counts[at[same]], counts_anew
    out = np.empty(counts.sum(), np.int32)
    begins = np.cumsum(counts) - counts
    out[_ragged(begins[short[same]], counts[short[same]])] = memory.flat[_ragged(memory.begins[at[same]], counts[short[same]])]
    out[_ragged(begins[anew], counts_anew)] = flat
    per_row = np.bincount(row, counts, n).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(per_row)))
    unknown = np.flatnonzero(out >= vocab.size)
    if len(unknown):  # characters without a piece go to their bytes
        spelled = [chr(x - vocab.size).encode() for x in out[unknown].tolist()]
        sizes = np.ones(len(out), np.int64)
        sizes[unknown] = [len(s) for s in spelled]
        shift = np.concatenate(([0], np.cumsum(sizes)))
        longer = np.repeat(out, sizes)
        longer[_ragged(shift[unknown], sizes[unknown])] = vocab.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        out, bounds = longer, shift[bounds]
    return out.astype(np.int32), bounds


def _units(vocab: Vocabulary, singles: np.ndarray, starts: np.ndarray, lengths: np.ndarray, units: np.ndarray, limit: int, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of units, one unit after another, and their numbers; ``seen`` is given the units and names of all candidates of short ones."""
    counts, parts, where = np.zeros(len(starts), np.int64), [], []
    low = 0
    for width in (2, 4, 6, 8, 10, 12, 16, 24, 40, LONGEST):
        pick = np.flatnonzero((lengths > low) & (lengths <= width))
        low = width
        for a in range(0, len(pick), 1 << 15):
            some = pick[a : a + (1 << 15)]
            at = np.minimum(starts[some][:, None] + np.arange(width), len(singles) - 1)
            met: list | None = None if seen is None else []
            got, counts[some] = _side_by_side(vocab, singles[at], lengths[some], units[some], limit, met)
            if seen is not None:
                seen += [(some[r], names) for r, names in met]
            parts.append(got)
            where.append(some)
    for i in np.flatnonzero(lengths > LONGEST).tolist():
        got = _one(vocab, singles[starts[i] : starts[i] + lengths[i]].tolist(), units[i], limit)
        counts[i] = len(got)
        parts.append(np.array(got, np.int32))
        where.append(np.array([i]))
    flat = np.empty(counts.sum(), np.int32)
    begins = np.cumsum(counts) - counts
    for part, some in zip(parts, where):
        flat[_ragged(begins[some], counts[some])] = part
    return flat, counts


class Decoder:
    def __init__(self, vocab: Vocabulary) -> None:
        self.lengths = np.array([len(p) for p in vocab.pieces], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(vocab.pieces), np.uint8)

    def __call__(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of rows of pieces, without the mark before each text."""
        lengths = self.lengths[ids]
        raw = self.flat[_ragged(self.begins[ids], lengths)]
        offsets = np.concatenate(([0], np.cumsum(lengths)))[bounds]
        filled = np.diff(offsets) > 0
        keep = np.ones(len(raw), bool)
        keep[offsets[:-1][filled]] = False
        return raw[keep], np.concatenate(([0], np.cumsum(np.diff(offsets) - filled)))


def _equal_rows(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """Which rows of two packed columns are the same."""
    return np.array([x == y and np.array_equal(a[p:q], b[p2:q2]) for x, y, p, q, p2, q2 in zip(np.diff(a_at), np.diff(b_at), a_at[:-1], a_at[1:], b_at[:-1], b_at[1:])], bool)


def _again(raw: np.ndarray, offsets: np.ndarray, keys: np.ndarray, i: int, ids: np.ndarray, bounds: np.ndarray, vocab: Vocabulary, decode: Decoder, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(ids, bounds) with row i encoded anew, and whether it decodes to its text."""
    own, at = raw[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]])
    new, good = ids[bounds[i] : bounds[i + 1]], False
    for salt in range(1, 5):
        new, new_at = encode(own, at, keys[i : i + 1], vocab, dropout, seed, None, salt)
        good = bool(_equal_rows(own, at, *decode(new, new_at))[0])
        if good:
            break
    shift = len(new) - (bounds[i + 1] - bounds[i])
    return np.concatenate((ids[: bounds[i]], new, ids[bounds[i + 1] :])), np.concatenate((bounds[: i + 1], bounds[i + 1 :] + shift)), good


ENCODED_DDL = "doc_id long, n_pieces long, pieces array<int>, lossless boolean"
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("pieces", pa.list_(pa.int32())), ("lossless", pa.bool_())])


def encode_texts(docs: DataFrame, model_file: str = MODEL, dropout: float = DROPOUT, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, pieces, and whether they decode to the very text, for each row's whole text.

    A null text is encoded as an empty one, which has no pieces; rows with equal ids and equal texts
    get equal pieces, null ids count as one id; other columns are ignored; an empty table gives an
    empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model_file))  # the vocabulary, some 10 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        decode, memory = Decoder(vocab), Memory()
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            for a, b in slices(offsets, SLICE):
                part, offs = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                out, bounds = encode(part, offs, ids[a:b], vocab, dropout, seed, memory)
                back, at = decode(out, bounds)
                same = _equal_rows(part, offs, back, at)
                for i in np.flatnonzero(~same).tolist():
                    # two units had one hash: the row alone, under other hashes
                    out, bounds, same[i] = _again(part, offs, ids[a:b], i, out, bounds, vocab, decode, dropout, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out)), pa.array(same)], schema=ENCODED)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), ENCODED_DDL)


def decode_texts(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id and text of rows of pieces; null pieces are an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model_file))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(shared.value)
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                x = np.array(ids.as_py() or [], np.int64)
                raw, _ = decode(x, np.array([0, len(x)]))
                texts.append(raw.tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")
