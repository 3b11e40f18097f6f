"""An FM-index over a shard of symbols: suffix array, wavelet matrix, backward search, sampled positions. All steps are numpy over whole arrays."""

from __future__ import annotations

import numpy as np


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of `t` in order; `t` must end with its only 0, the smallest symbol.

    The first sort takes as many symbols as fit a 63-bit key. Later rounds look only
    at suffixes still tied and triple (for very long texts double) the compared
    length, taking earlier ranks as keys.
    """
    n = len(t)
    bits = max(1, int(t.max()).bit_length())
    h = 63 // bits
    padded = np.concatenate([t.astype(np.int64), np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = (key << bits) | padded[j : j + n]
    sa = np.argsort(key)
    key = key[sa]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    wide = n.bit_length()
    looks = 2 if 3 * wide <= 63 else 1
    rows = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))
    while len(rows):
        pos = sa[rows]
        key = rank[pos]
        for k in range(1, looks + 1):
            at = pos + k * h
            key = (key << wide) | np.where(at < n, rank[np.minimum(at, n - 1)] + 1, 0)
        order = np.argsort(key)
        key, pos = key[order], pos[order]
        sa[rows] = pos
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[pos] = np.maximum.accumulate(np.where(first, rows, 0))
        rows = rows[~(first & np.concatenate([first[1:], [True]]))]
        h *= looks + 1
    return sa


class FmIndex:
    """Counts and places phrases in a shard. Symbols of a shard are 1 and above."""

    def __init__(self, symbols: np.ndarray, sample: int = 16) -> None:
        t = np.concatenate([symbols.astype(np.int64), [0]])
        sa = suffix_array(t)
        self.size, sigma = len(t), int(t.max()) + 1
        self.levels = max(1, (sigma - 1).bit_length())
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=1 << self.levels))])
        # Wavelet matrix: at each level, the zeros before each place; zeros go first in the next level.
        cur = t[sa - 1]
        self.zeros: list[np.ndarray] = []
        for level in range(self.levels - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(bool)
            zeros = np.zeros(self.size + 1, np.int32)
            np.cumsum(~bit, out=zeros[1:])
            self.zeros.append(zeros)
            cur = np.concatenate([cur[~bit], cur[bit]])
        symbol = np.arange(1 << self.levels)
        self.base = self._down(symbol, np.zeros(len(symbol), np.int64))
        held = sa % sample == 0
        self.held = held
        self.before = np.concatenate([[0], np.cumsum(held)])
        self.samples = sa[held]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, zeros in enumerate(self.zeros):
            z = zeros[at]
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            at = np.where(one, zeros[-1] + at - z, z)
        return at

    def _rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        return self._down(symbol, at) - self.base[symbol]

    def _back(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that start one symbol earlier."""
        symbol, at = np.zeros(len(row), np.int64), row
        for zeros in self.zeros:
            z = zeros[at]
            one = zeros[at + 1] == z
            symbol = symbol << 1 | one
            at = np.where(one, zeros[-1] + at - z, z)
        return self.starts[symbol] + at - self.base[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of phrases, by backward search; `phrases` is padded on its left."""
        n, width = phrases.shape
        low, high = np.zeros(n, np.int64), np.full(n, self.size)
        alive = np.arange(n)
        for k in range(width):
            alive = alive[(lengths[alive] > k) & (low[alive] < high[alive])]
            symbol = phrases[alive, width - 1 - k]
            known = symbol < 1 << self.levels
            high[alive[~known]] = low[alive[~known]]
            alive, symbol = alive[known], symbol[known]
            low[alive] = self.starts[symbol] + self._rank(symbol, low[alive])
            high[alive] = self.starts[symbol] + self._rank(symbol, high[alive])
        return low, np.maximum(high, low)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled suffix."""
        out, todo, steps = np.empty(len(row), np.int64), np.arange(len(row)), 0
        while len(todo):
            here = self.held[row]
            out[todo[here]] = self.samples[self.before[row[here]]] + steps
            todo, row, steps = todo[~here], self._back(row[~here]), steps + 1
        return out
