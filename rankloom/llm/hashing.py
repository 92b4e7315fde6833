"""Vectorised hashing of words and byte windows over Arrow text columns.

Texts are handled as UTF-8 bytes, a few megabytes at a time. All hashes are 64 bits, sums of random byte codes times powers of
an odd base (so that a window's hash comes from two prefix sums), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 2 << 20
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
LOWER_CODES = CODES[_LOWER]
#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=2)
def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, U(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _table(n: int, base: np.uint64) -> np.ndarray:
    size = CHUNK + 1
    while size < n:
        size *= 2
    return powers(size, int(base))[:n]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of at most limit bytes, or one longer row. Nulls count as empty."""
    column = column.cast(pa.large_string()).cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets_at, data_at = column.buffers()
    offsets = np.frombuffer(offsets_at, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_at, dtype=np.uint8) if data_at is not None and data_at.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def prefix_sums(data: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(codes[data] * _table(len(data), BASE), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end); equal bytes have equal hashes wherever they stand."""
    inverse = _table(len(sums), INVERSE)
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row (and one past the last) the number of words before it."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    dark = ~SPACE[data]
    first = np.empty(len(data), dtype=bool)
    first[0] = True
    first[1:] = ~dark[:-1]
    inner = offsets[offsets < len(data)]
    first[inner] = True
    last = np.empty(len(data), dtype=bool)
    last[-1] = True
    last[:-1] = ~dark[1:]
    last[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(dark & first)
    return starts, np.flatnonzero(dark & last) + 1, np.searchsorted(starts, offsets)


_MULT = [U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3), U(0x1D8E4E27C47D124F)]


def runs_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, U(k), dtype=np.uint64)
    for j in range(k):
        out = mix(out * _MULT[j % 5] + words[j : j + n])
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(data, LOWER_CODES), starts, ends)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles, A-Z lower-cased); fewer words: one shingle; none: empty."""
    for first, data, offsets in chunks(column):
        starts, ends, before = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        shingles = runs_hash(words, k)
        for i in range(len(offsets) - 1):
            a, b = before[i], before[i + 1]
            if b - a >= k:
                s = np.sort(shingles[a : b - k + 1])
                yield first + i, s[np.concatenate(([True], s[1:] != s[:-1]))]
            else:
                yield first + i, runs_hash(words[a:b], int(b - a)) if b > a else shingles[:0]


def set_id(hashes: np.ndarray) -> int:
    """A 64-bit identity of a set of hashes, as a signed number."""
    if not len(hashes):
        return 0
    total = np.array([mix(hashes).sum()], dtype=np.uint64) + np.array([len(hashes)], dtype=np.uint64) * _MULT[0]
    return int(mix(total).view(np.int64)[0])
