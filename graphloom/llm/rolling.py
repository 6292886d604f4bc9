"""Hashes of words and of windows of words for whole batches of texts, in numpy.

A batch is turned into one byte buffer; a polynomial prefix sum modulo 2^64 gives every word's hash in a few passes,
and shifted sums of word hashes give those of all windows. Memory is bounded by CHUNK bytes (or one text, if larger).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two rounds of xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def odd(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that follow from ``seed`` alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTES = odd(11, 256)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        with np.errstate(over="ignore"):
            made = []
            for base in (_BASE, _INVERSE):
                p = np.full(size, base, dtype=_U)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, in order."""
    if not words:
        return np.empty(0, dtype=_U)
    joined = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    ends = np.flatnonzero(joined == 32)
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    power, inverse = _powers_to(len(joined) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(joined) + 1, dtype=_U)
        np.cumsum(_BYTES[joined] * power[: len(joined)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every window of ``width`` word hashes (len - width + 1 of them, or none)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=_U)
        for k, c in enumerate(odd(1000 + seed, width)):
            total += hashes[k : k + n] * c
        return mix(total)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end]) + 1
            end += 1
        yield at, end
        at = end


def inside(lengths: np.ndarray, width: int) -> np.ndarray:
    """For the words of texts laid end to end: whether a window of ``width`` that starts there stays in its text.

    Has one entry for each window of the joined words.
    """
    total = int(lengths.sum())
    n = max(total - width + 1, 0)
    ends = np.repeat(np.cumsum(lengths), lengths)[:n]
    return np.arange(n) + width <= ends
