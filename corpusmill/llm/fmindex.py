"""An FM-index over integer sequences in numpy: wavelet matrix, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np

#: Every so many positions one suffix position is kept.
SAMPLE = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions in the order of their suffixes, by prefix doubling over the groups that are still tied."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable").astype(np.int64)
    rank = np.empty(n, np.int64)
    sorted_symbols = symbols[order]
    fresh = np.r_[True, sorted_symbols[1:] != sorted_symbols[:-1]] if n else np.empty(0, bool)
    head = np.flatnonzero(fresh)
    rank[order] = head[np.cumsum(fresh) - 1] if n else 0
    step = 1
    while True:
        # Rows whose group has more than one member; the others have their final place.
        r = rank[order]
        tied = np.flatnonzero(np.r_[r[1:] == r[:-1], False] | np.r_[False, r[1:] == r[:-1]]) if n > 1 else np.empty(0, np.int64)
        if not len(tied):
            return order
        at = order[tied]
        ahead = at + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        local = np.lexsort((second, rank[at]))
        at, second = at[local], second[local]
        first = rank[at]
        order[tied] = at
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        rank[at] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        step *= 2


class WaveletMatrix:
    """rank(symbol, i): how often the symbol stands in the first i places; both arguments may be arrays."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            ones = np.r_[np.int32(0), np.cumsum(bit, dtype=np.int32)]
            self.levels.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def at(self, i: np.ndarray) -> np.ndarray:
        value = np.zeros_like(i)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            bit = ones[i + 1] - ones[i]
            value = value * 2 + bit
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return value


class FmIndex:
    """Symbols are 1..size; zero separates stretches and occurs in no pattern.

    Each separator is a symbol of its own in the suffix order, so suffixes are told apart within their stretch.
    """

    def __init__(self, symbols: np.ndarray, size: int):
        n = len(symbols)
        gap = symbols == 0
        stops = int(gap.sum())
        distinct = np.where(gap, np.cumsum(gap) - 1, symbols.astype(np.int64) + stops - 1 + 1)
        order = suffix_array(distinct)
        before = np.where(order > 0, symbols[order - 1], 0).astype(np.int64)
        self.wavelet = WaveletMatrix(before, max(1, int(size).bit_length()))
        self.first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=size + 1))].astype(np.int64)
        # Kept: each SAMPLE-th position, and those after a separator, so that no walk leaves its stretch.
        kept = (order % SAMPLE == 0) | (before == 0)
        self.kept = np.r_[0, np.cumsum(kept)]
        self.places = order[kept]
        self.n = n

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix order that start with each pattern (rows of symbols, read up to their length)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > back) & (lo < hi))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - back].astype(np.int64)
            base = self.first[symbol]
            lo[live], hi[live] = base + self.wavelet.rank(symbol, lo[live]), base + self.wavelet.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows of the suffix order, by walking back to a kept one."""
        place = np.empty(len(rows), np.int64)
        live, row, walked = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(live):
            here = self.kept[row + 1] - self.kept[row] == 1
            place[live[here]] = self.places[self.kept[row[here]]] + walked
            live, row = live[~here], row[~here]
            symbol = self.wavelet.at(row)
            row = self.first[symbol] + self.wavelet.rank(symbol, row)
            walked += 1
        return place
