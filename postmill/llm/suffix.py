"""Suffix arrays, wavelet matrices and FM-indexes over word numbers, vectorised with numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``symbols``; 0 is a separator and ends the comparison, ties go by position.

    The last symbol must be 0. As many symbols as fit 62 bits are sorted at once, then prefixes double in
    length, each time only for suffixes that still tie.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    width = min(n, max(1, 62 // bits))
    key, ended = symbols.astype(np.int64), symbols == 0
    for k in range(1, width):
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = symbols[k:]
        nxt[ended] = 0
        key = (key << bits) | nxt
        ended = ended | (nxt == 0)
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    new |= ended[sa]  # equal to the separator: the stable sort has ordered them by position
    row = np.arange(n, dtype=np.int64)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, row, 0))
    open_rows = _tied(new)
    depth = width
    while len(open_rows):
        at = sa[open_rows]
        first, second = rank[at], rank[np.minimum(at + depth, n - 1)]
        order = np.argsort(first * n + second, kind="stable")
        at, first, second = at[order], first[order], second[order]
        sa[open_rows] = at
        fresh = np.empty(len(at), bool)
        fresh[0] = True
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[at] = np.maximum.accumulate(np.where(fresh, open_rows, 0))
        open_rows = open_rows[_tied(fresh)]
        depth *= 2
    return sa


def _tied(new: np.ndarray) -> np.ndarray:
    """Indexes that share their group with another one; ``new`` marks the first of each group."""
    last = np.empty(len(new), bool)
    last[:-1], last[-1] = new[1:], True
    return np.flatnonzero(~(new & last))


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w, off = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << off) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Wavelet matrix: rank of any symbol in as many steps as a symbol has bits."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.shifts = list(range(max(1, (sigma - 1).bit_length()) - 1, -1, -1))
        self.levels, self.zeros = [], []
        now = symbols
        for s in self.shifts:
            bit = (now >> s) & 1 == 1
            self.levels.append(Bits(bit))
            now = np.concatenate((now[~bit], now[bit]))
            self.zeros.append(len(now) - int(bit.sum()))
        self.starts = np.zeros(sigma, np.int64)
        self.starts = self.walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for s, level, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            ones = level.rank(i)
            i = np.where((c >> s) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before i."""
        return self.walk(c, i) - self.starts[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and its rank there."""
        c = np.zeros(len(i), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = level.get(i), level.rank(i)
            c = (c << 1) | one
            i = np.where(one, zeros + ones, i - ones)
        return c, i - self.starts[c]


class FMIndex:
    """FM-index of one shard of word numbers; 0 separates runs of words and the last symbol is 0."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 8):
        sa = suffix_array(symbols)
        self.wavelet = Wavelet(symbols[sa - 1], sigma)  # -1 wraps to the last separator
        counts = np.bincount(symbols, minlength=sigma)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        starts = np.zeros(len(symbols), bool)  # first words of runs are sampled: walks never cross a separator
        starts[0] = True
        starts[1:] = symbols[:-1] == 0
        kept = starts[sa] | (sa % sample == 0)
        self.sampled, self.positions = Bits(kept), sa[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each phrase, by backward search; phrases are right-aligned in a matrix of symbols."""
        width = phrases.shape[1]
        last = phrases[:, width - 1]
        lo, hi = self.first[last].copy(), self.first[last + 1].copy()
        for k in range(2, width + 1):
            live = np.flatnonzero((lengths >= k) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, width - k]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back with LF until a sampled suffix."""
        out = np.empty(len(rows), np.int64)
        live, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(live):
            hit = self.sampled.get(at)
            out[live[hit]] = self.positions[self.sampled.rank(at[hit])] + steps
            live, at, steps = live[~hit], at[~hit], steps + 1
            if len(live):
                c, r = self.wavelet.access(at)
                at = self.first[c] + r
        return out
