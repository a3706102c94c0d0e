"""Word hashes of whole texts by array operations on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_POLY = _U(0xD6E8FEB86659FD93)

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
#: Between words: space and the controls 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Between words: every ASCII character other than letters and digits.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 places where its values start and end; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def word_hashes(data: np.ndarray, ends: np.ndarray, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, A-Z lower-cased, and the n + 1 places where each value's words start and end."""
    if not len(data):
        return np.empty(0, _U), np.zeros(len(ends), np.int64)
    apart = between[data]
    start = ~apart
    start[1:] &= apart[:-1]
    edges = ends[:-1][ends[:-1] < len(data)]
    start[edges] = ~apart[edges]
    begins = np.flatnonzero(start)
    if not len(begins):
        return np.empty(0, _U), np.zeros(len(ends), np.int64)
    lengths = np.diff(np.append(begins, len(data)))
    place = np.arange(begins[0], len(data)) - np.repeat(begins, lengths)
    powers = np.cumprod(np.concatenate(([_U(1)], np.full(int(lengths.max()), _POLY))))
    values = _ASCII_LOWER[data[begins[0] :]].astype(_U) + _U(1)
    values[apart[begins[0] :]] = 0
    values *= powers[place]
    hashes = mix(np.add.reduceat(values, begins - begins[0]) + _GOLDEN)
    return hashes, np.searchsorted(begins, ends)


def shingles(hashes: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of ``width`` words, and where each value's start and end.

    A value with fewer words has one shingle, the whole sequence; without words none.
    """
    n = np.diff(ends)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    to = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(to[-1]) + np.repeat(ends[:-1] - to[:-1], count)
    stop = np.repeat(ends[1:], count)
    padded = np.append(hashes, np.zeros(width, _U))
    out = np.zeros(len(at), _U)
    for k in range(width):
        word = padded[at + k]
        word[at + k >= stop] = 0
        out = mix(out * _POLY + word + _GOLDEN)
    return out, to
