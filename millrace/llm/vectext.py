"""Vectorised text work on Arrow buffers, shared by the operators of this subpackage.

Every function takes the UTF-8 bytes of many texts at once and works on them with numpy, so that the
cost of Python is paid per batch and never per word. Texts are cut into slices of bounded size between
texts (a text longer than a slice forms a slice of its own and is still processed whole).

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text;
in a regular expression, whatever ``[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+`` does not match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators between words, for SQL and Java regular expressions alike.
WORD_BREAK = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"

_U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
#: A random 64-bit value for each byte.
BYTE_CODE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_IS_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 57), (97, 122), (128, 255)):
    _IS_WORD[_lo : _hi + 1] = True
_powers = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    if _powers["n"] < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[key] = np.cumprod(out, dtype=np.uint64)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the public splitmix64 steps), in place where it can be."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def slices(column: pa.Array | pa.ChunkedArray, most: int = 1 << 19, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) for runs of texts of about `most` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.dtype(np.int64) if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.dtype(np.int32)

    def raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, data = a.buffers()
        o = np.frombuffer(offsets, width)[a.offset : a.offset + len(a) + 1].astype(np.int64)
        b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return b[o[0] : o[-1]], o - o[0]

    lengths = raw(column)[1]
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(lengths, lengths[start] + most, "right")) - 1)
        stop = min(stop, n)
        part = column.slice(start, stop - start)
        data, offsets = raw(pc.utf8_lower(part) if lower else part)
        yield start, stop - start, data, offsets
        start = stop


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the row it is in. No word crosses from one text into the next."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = is_word[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() reads the hash of any byte span."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_CODE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The hash of the bytes from s to e: the same bytes give the same hash at every place and in every batch."""
    _, down = powers(len(sums))
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and for each text where its words begin (rows + 1 values)."""
    s, e, row = spans(data, offsets)
    return span_hash(prefix_hash(data), s, e), np.searchsorted(row, np.arange(len(offsets)))


def grams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows that lie in one text, with the bounds of each text's windows.

    A text with fewer than n words, but at least one, has one window of all its words."""
    count = np.diff(bounds)
    if not len(hashes):
        return hashes, bounds.copy()
    up = powers(n + 1)[0]
    total = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        total[: len(hashes) - k] += hashes[k:] * up[k + 1] if k < len(hashes) else 0
    windows = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    out = np.concatenate(([0], np.cumsum(windows)))
    at = np.repeat(bounds[:-1] - out[:-1], windows) + np.arange(out[-1])
    g = total[at]
    for r in np.flatnonzero((count > 0) & (count < n)):
        c = int(count[r])
        g[out[r]] = (hashes[bounds[r] : bounds[r + 1]] * up[1 : c + 1]).sum(dtype=np.uint64)
    return mix(g), out


def sorted_sets(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct values in ascending order."""
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def popcount_rows(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)
