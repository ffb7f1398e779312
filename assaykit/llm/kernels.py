"""Vectorised text kernels on byte buffers (numpy only, no Spark).

Texts travel as one contiguous ``uint8`` buffer plus offsets, which is how Arrow
hands them over, so no Python string is ever built on the hot paths.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the rolling values and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Texts are handled in groups of about so many bytes, which bounds the scratch arrays.
GROUP_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes when words are split on ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


@lru_cache(maxsize=1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed scratch memory back to the system; workers are reused and would keep it."""
    if trim := _trim():
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a bijection of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Keeps the first k bytes of eight.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
#: Longer ranges are hashed as the hashes of their pieces of so many bytes.
PIECE = 256


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes a round, each round a bijection of what it mixes in.

    Ranges of at most eight bytes of one length never collide, others only by chance: no
    sum of powers is involved that structured texts could cancel.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    out = size.astype(U64) * U64(0x2545F4914F6CDD1D)
    long = np.flatnonzero(size > PIECE)
    rows = np.flatnonzero(size <= PIECE) if len(long) else None
    at, left = (start, size) if rows is None else (start[rows], size[rows])
    while len(at):
        x = eight[at]
        x &= KEEP[np.minimum(left, 8)]
        if rows is None:
            out = mix64(out ^ x)
        else:
            out[rows] = mix64(out[rows] ^ x)
        more = np.flatnonzero(left > 8)
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8
    if len(long):
        pieces = -(-size[long] // PIECE)
        last = np.cumsum(pieces)
        first = np.repeat(start[long], pieces) + (np.arange(last[-1]) - np.repeat(last - pieces, pieces)) * PIECE
        parts = hash_ranges(data, first, np.minimum(first + PIECE, np.repeat(end[long], pieces)))
        out[long] = mix64(out[long] ^ hash_ranges(parts.view(np.uint8), (last - pieces) * 8, last * 8))
    return out


def same_ranges(data: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the ranges hold the same bytes as those of equal sizes that begin at ``other``."""
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    bad = data[np.repeat(start, size) + step] != data[np.repeat(other, size) + step]
    wrong = np.zeros(len(size), bool)
    wrong[np.repeat(np.arange(len(size)), size)[bad]] = True
    return ~wrong


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, GROUP_BYTES + 1024)
        for k, base in enumerate((BASE, BASE_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A value for each ``width`` consecutive bytes, equal for equal bytes. It picks places; it is no proof of equality."""
    power, inverse = _power_tables(len(data) + 1)
    value = _BYTE_VALUE[data]
    value *= power[: len(data)]
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(value, out=sums[1:])
    out = sums[width:] - sums[:-width]
    out *= inverse[: len(out)]
    return out


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary Arrow column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, values = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES):
    """Row ranges of at most ``limit`` bytes each (a longer text stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of a group of texts: bounds, owning text, and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE, lower: bool = False, hashes: bool = True):
        inside = is_word[data]
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[cut] = inside[cut]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: bounds[i]:bounds[i + 1] are the words of text i
        self.bounds = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.bounds)
        self.hash = hash_ranges(LOWER[data] if lower else data, self.start, self.end) if hashes else None

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


_GRAM_MULTIPLIERS = mix64(np.arange(11, 75, dtype=U64)) | U64(1)


def gram_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words; entry i starts at word i. Callers discard those that cross texts."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = word_hash[:m] * _GRAM_MULTIPLIERS[0]
    for k in range(1, n):
        out += word_hash[k : k + m] * _GRAM_MULTIPLIERS[k]
    return mix64(out)


def gram_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """True where a window of n words that starts at that word stays in its text."""
    total = int(bounds[-1])
    ok = np.zeros(max(total - n + 1, 0), bool)
    if len(ok):
        size = np.diff(bounds)
        counts = np.maximum(size - n + 1, 0)
        mark = np.zeros(total + 1, np.int32)
        full = counts > 0
        np.add.at(mark, bounds[:-1][full], 1)
        np.add.at(mark, bounds[:-1][full] + counts[full], -1)
        ok[:] = np.cumsum(mark)[: len(ok)] > 0
    return ok


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    done, m = 1, x
    while done * 2 <= width:
        m = np.minimum(m[: len(m) - done], m[done:])
        done *= 2
    return np.minimum(m[:n], m[width - done : width - done + n]) if done < width else m[:n]
