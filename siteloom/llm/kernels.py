"""Vectorised text kernels shared by the operators: words, digests and windows of a whole text in numpy.

A word is a maximal run of code points other than U+0020 and U+0009 to U+000D. All of these are single
bytes in UTF-8, so the kernels run on the encoded text and never build a Python object for each word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: bytes.translate table that lower-cases A-Z and nothing else
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits: every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(_BASE))


_BYTES = seeded(256, 11)
_powers = np.ones(1, dtype=_U)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 256)
        steps = np.full(size, _BASE, dtype=_U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(steps)
    return _powers


class Words(NamedTuple):
    data: np.ndarray  # the bytes
    start: np.ndarray  # byte offset of each word
    end: np.ndarray  # byte offset behind each word
    separators: int  # number of separator bytes


def words(raw: bytes, separator: np.ndarray = SEPARATOR) -> Words:
    data = np.frombuffer(raw, dtype=np.uint8)
    sep = separator[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, 0)
    edge[0] = not sep[0]
    edge[-1] = not sep[-1]
    np.not_equal(sep[1:], sep[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    return Words(data, at[0::2], at[1::2], int(np.count_nonzero(sep)))


def span_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each non-empty, disjoint, ascending byte span."""
    if not len(start):
        return np.zeros(0, dtype=_U)
    size = end - start
    first = np.cumsum(size) - size
    at = np.arange(int(first[-1] + size[-1]), dtype=np.int64)
    inside = at - np.repeat(first, size)
    taken = data[inside + np.repeat(start, size)] if int(size.sum()) != len(data) else data
    with np.errstate(over="ignore"):
        each = _BYTES[taken] * _power_table(int(size.max()))[inside]
        return mix(np.add.reduceat(each, first) + size.astype(_U) * _U(0xD6E8FEB86659FD93))


def word_digests(raw: bytes) -> np.ndarray:
    w = words(raw)
    return span_digests(w.data, w.start, w.end)


_SHIFTS = seeded(64, 29) | _U(1)


def run_digests(digests: np.ndarray, first: np.ndarray, kind: int = 0) -> np.ndarray:
    """A digest of each run of words; the runs begin at ``first`` and cover all words."""
    if not len(digests):
        return digests
    size = np.diff(first, append=len(digests))
    inside = np.arange(len(digests)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(mix(digests) * _power_table(int(size.max()))[inside], first) + size.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(kind))


def window_digests(digests: np.ndarray, n: int) -> np.ndarray:
    """A digest of each n consecutive words; of all of them as one window where there are fewer."""
    if not len(digests):
        return digests
    n = min(n, len(digests))
    out = np.zeros(len(digests) - n + 1, dtype=_U)
    with np.errstate(over="ignore"):
        for k in range(n):
            out += digests[k : len(digests) - n + 1 + k] * _SHIFTS[k]
        return mix(out + _U(n))


def shingle_set(raw: bytes, n: int = 5) -> np.ndarray:
    """The sorted distinct n-word windows of a text that is already lower-cased."""
    return np.unique(window_digests(word_digests(raw), n))


def lower_utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER)


def char_offsets(data: np.ndarray) -> np.ndarray:
    """For each byte offset, and the end, the number of code points before it."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
