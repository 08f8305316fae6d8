"""Words and word shingles of texts as 64-bit hashes, in flat numpy arrays.

A word is a run of bytes outside space and 09-0D, with A-Z lower-cased. Hashes are polynomials over random
64-bit values of the bytes, mixed; equal words or shingles have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quoteflow.llm.common import flat

_PIECE = 1 << 20
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWER or len(_POWER[0]) < n:
        _POWER[:] = [_powers(_BASE, n), _powers(_INVERSE, n)]
    return _POWER[0], _POWER[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64 over all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_spans(data: np.ndarray, ends: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; the end of a text ends a word. ``breaks`` says which bytes are outside words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~breaks[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = ends[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans come in order and don't overlap."""
    return polynomials(data, begin, end, _BYTE)


def polynomials(values: np.ndarray, begin: np.ndarray, end: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A hash of the values of each span, or of what ``table`` has for them."""
    out = np.zeros(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        at = int(begin[i])
        j = max(i + 1, int(np.searchsorted(end, at + _PIECE, side="right")))
        n = int(end[j - 1]) - at
        power, inverse = _tables(max(n, _PIECE) + 1)
        part = values[at : at + n]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((part if table is None else table[part]) * power[:n], out=total[1:])
        b, e = begin[i:j] - at, end[i:j] - at
        out[i:j] = (total[e] - total[b]) * inverse[b]
        i = j
    return mix(out + (end - begin).astype(np.uint64) * _STEP)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a column of texts, and where each text's words begin and the last's end."""
    data, ends = flat(column)
    begin, end = word_spans(data, ends)
    return span_hashes(data, begin, end), np.searchsorted(begin, ends)


def _run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= _STEP
        out += hashes[k : len(hashes) - n + 1 + k]
    return mix(out + _U((n * 0x5851F42D4C957F2D) & 0xFFFFFFFFFFFFFFFF))


def runs(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of n words inside a text, text by text, and how many each text has."""
    lens = np.maximum(np.diff(at) - n + 1, 0)
    total = int(lens.sum())
    if not total:
        return hashes[:0], lens
    place = np.arange(total) + np.repeat(at[:-1] - (np.cumsum(lens) - lens), lens)
    return _run_hashes(hashes, n)[place], lens


def shingles(hashes: np.ndarray, at: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its n-word shingles in order, repeats included.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    whole, lens = runs(hashes, at, n)
    end = 0
    for a, b, k in zip(at[:-1].tolist(), at[1:].tolist(), lens.tolist(), strict=True):
        if k:
            yield whole[end : end + k]
            end += k
        else:
            yield _run_hashes(hashes[a:b], b - a) if b > a else hashes[:0]
