"""Vectorised helpers that run inside Arrow tasks: word bounds and hashes over the raw UTF-8 of a record batch.

Words are runs of bytes other than space and 0x09-0x0D, so they never cut a code point. All hashes are
64 bit, depend on the bytes alone and are the same on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; one longer text is handled alone.
CHUNK_BYTES = 1 << 21

_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE_LOWER = _VALUE[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        table = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        table[0] = 1
        kept = np.multiply.accumulate(table)
        if n > 4 * CHUNK_BYTES:
            return kept
        _powers[key] = kept
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) for runs of rows of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest runs of one kind (0: not wanted) that do not cross a row's bounds."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.empty(len(kind) + 1, bool)
    cut[0] = cut[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    wanted = kind[edges[:-1]] != 0
    return edges[:-1][wanted], edges[1:][wanted]


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Sums from which span_hash takes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_VALUE_LOWER if lower else _VALUE)[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes from start to end, wherever they stand."""
    back = _power(_BASE_INV, len(sums))
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first and the end position, in a sorted list of starts, of each row's spans."""
    return np.searchsorted(starts, offsets)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbours; the last n - 1 positions of the result are missing."""
    count = max(len(hashes) - n + 1, 0)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = mix(out * _BASE + hashes[k : k + count] + np.uint64(n))
    return out


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles, A-Z lower-cased.

    A row of fewer words has its whole sequence as the only shingle; one without words has none.
    """
    for _, data, offsets in chunks(column):
        starts, ends = runs(~SEPARATOR[data], offsets)
        words = span_hash(prefix_hash(data, lower=True), starts, ends)
        grams = combine(words, n)
        bounds = rows_of(starts, offsets)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield combine(words[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


_KIND = np.full(256, 2, np.uint8)
_KIND[SEPARATOR] = 0
_KIND[0x80:] = 1
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1


def hashed_ngrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets below 2 ** bits of a chunk's unigrams and bigrams, and the bounds of each row's.

    Tokens are runs of letters and digits (all of non-ASCII counts as letters) and runs of other signs.
    """
    starts, ends = runs(_KIND[data], offsets)
    tokens = span_hash(prefix_hash(data), starts, ends)
    bounds = rows_of(starts, offsets)
    pairs = combine(tokens, 2)
    pairs[tokens[1:] == tokens[:-1]] = 1  # any token twice running is one bigram: "the one before, again"
    out = np.zeros((len(tokens), 2), np.uint64)
    out[:, 0] = tokens
    out[:-1, 1] = pairs
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    out[last, 1] = tokens[last] + np.uint64(1)  # a row's last token meets the row's end
    return (mix(out.ravel()) >> np.uint64(64 - bits)).astype(np.int64), bounds * 2


def row_means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The mean of each row's values; 0 for a row without any. It depends on the row alone, to the last bit."""
    counts = np.diff(bounds)
    full = counts > 0
    out = np.zeros(len(counts))
    if full.any():
        out[full] = np.add.reduceat(values.astype(np.float64), bounds[:-1][full]) / counts[full]
    return out
