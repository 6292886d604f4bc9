"""Two-dimensional range reporting: a wavelet tree, stored level by level, that answers many queries at a time in numpy."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Over numbers below 2^bits, in order. At each level numbers are parted by one bit, those with 0 first; ``ones`` counts the ones before each place."""

    def __init__(self, values: np.ndarray):
        v = values.astype(np.int64)
        self.bits = max(1, int(v.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for k in range(self.bits - 1, -1, -1):
            bit = (v >> k & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            self.zeros.append(len(v) - int(bit.sum()))
            v = np.concatenate([v[~bit], v[bit]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, number) of all numbers at places lo <= place < hi with least <= number < most; for distinct numbers each once."""
        query = np.flatnonzero((lo < hi) & (least < most))
        lo, hi, base = lo[query], hi[query], np.zeros(len(query), dtype=np.int64)
        for level, k in enumerate(range(self.bits - 1, -1, -1)):
            a, b = self.ones[level][lo], self.ones[level][hi]
            side = np.int64(1) << k
            c, d = least[query], most[query]
            zero = (hi - b > lo - a) & (base + side > c) & (base < d)
            one = (b > a) & (base + side < d) & (base + 2 * side > c)
            z = self.zeros[level]
            lo = np.concatenate([(lo - a)[zero], z + a[one]])
            hi = np.concatenate([(hi - b)[zero], z + b[one]])
            base = np.concatenate([base[zero], base[one] + side])
            query = np.concatenate([query[zero], query[one]])
        return query, base
