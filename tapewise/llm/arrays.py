"""Vectorised text kernels over Arrow string buffers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  All kernels work
on slices of bounded size cut from an Arrow batch, so memory does not follow
the batch's row count; one row longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one longer row."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes ``inside``, none beyond its row."""
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(inside):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        inner = offsets[1:-1]
        before[inner[inner < len(inside)]] = False
        after[inner[inner > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and row numbers of all words."""
    return spans_of(~_SEPARATOR[raw], offsets)


def characters_before(raw: np.ndarray) -> np.ndarray:
    """For each byte place, the end included: the code points that begin before it."""
    return np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = _powers.get(base)
    if kept is None or len(kept[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 2**64), U64)
        up[0] = down[0] = 1
        kept = np.cumprod(up), np.cumprod(down)
        if size <= 2 * SLICE_BYTES:
            _powers[base] = kept
    return kept[0][:n], kept[1][:n]


class Hasher:
    """64-bit polynomial hashes of values[start:end], for many ranges at once.

    For hashed features only: some pairs of long ranges have equal hashes whatever the base is.  What
    must not be mixed up takes ``word_hashes`` and ``window_hashes``."""

    def __init__(self, values: np.ndarray, salt: int = 0) -> None:
        up, self.down = _power(_BASES[salt], len(values) + 1)
        self.salt, self.sums = salt, np.empty(len(values) + 1, U64)
        self.sums[0] = 0
        np.cumsum((values.astype(U64) + U64(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts], self.salt + 16 * salt)


def combined(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of the pairs (a, b), in this order."""
    return mix(a * U64(0x9E6C63D0876A9A35) + b, salt)


_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U64)
_STEPS = 64


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of raw[start:end]: length and lanes of 8 bytes, folded one after another.

    Every step goes through a mixer that is no polynomial, so equal hashes are left to chance; salts
    are independent.  From lane ``_STEPS`` on, a long word's lanes are hashed by their places and added."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))
    sizes = ends - starts
    salt = 3 * salt + 1
    out = mix(sizes.astype(U64) * U64(0xC2B2AE3D27D4EB4F), salt)
    live, step = np.flatnonzero(sizes > 0), 0
    while len(live) and step < _STEPS:
        left = sizes[live] - 8 * step
        out[live] = combined(out[live], lanes[starts[live] + 8 * step] & _TAIL[np.minimum(left, 8)], salt)
        live, step = live[left > 8], step + 1
    for i in live.tolist():
        at = np.arange(starts[i] + 8 * _STEPS, ends[i], 8)
        rest = lanes[at] & _TAIL[np.minimum(ends[i] - at, 8)]
        places = mix(np.arange(len(at)).astype(U64), salt + 1)
        out[i] = combined(out[i : i + 1], np.sum(combined(places, rest, salt + 2), dtype=U64, keepdims=True), salt + 1)[0]
    return out


def window_hashes(words: np.ndarray, rows: np.ndarray, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words (hashes) of one row, and each window's first word.

    A window is split into runs of powers of two; a run's hash is that of its halves."""
    if len(words) < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    run, span, out, done = words, 1, None, 0
    while True:
        if width & span:
            part = run[done:]
            out = part if out is None else combined(out[: len(part)], part, salt + 41)
            done += span
        if done == width:
            break
        run = combined(run[:-span], run[span:], salt + 2 * span)
        span *= 2
    first = np.flatnonzero(rows[width - 1 :] == rows[: len(rows) - width + 1])
    return out[first], first


def short_hashes(words: np.ndarray, first: np.ndarray, count: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of ``count`` words (hashes) from ``first`` on, for few words; they differ from those of windows."""
    out = mix(count.astype(U64), salt + 83)
    for k in range(int(count.max()) if len(count) else 0):
        more = np.flatnonzero(count > k)
        out[more] = combined(out[more], words[first[more] + k], salt + 83)
    return out


def pack_u64(values: np.ndarray) -> bytes:
    """Byte planes: the shuffle's own compression removes the planes of zeros."""
    return np.ascontiguousarray(values.astype("<u8")[:, None].view(np.uint8).T).tobytes()


def unpack_u64(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)
