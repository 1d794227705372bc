"""FM-index over a shard of word ids: suffix order, wavelet-matrix ranks, sampled suffix positions.

The text is an int array in which 0 is a separator. Every separator is a symbol of its own in the suffix
order (by position), so suffixes never compare beyond one and the order is total. Searching and locating
are vectorised over all patterns at once.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank over a symbol array, one packed bit vector a level."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.n, self.bits = len(symbols), bits
        self.words, self.before, self.zeros = [], [], []
        current = symbols
        for level in range(bits - 1, -1, -1):
            bit = ((current >> level) & 1).astype(np.uint8)
            packed = np.zeros(self.n // 64 + 1, np.uint64)
            raw = np.packbits(bit, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.words.append(packed)
            self.before.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            current = np.concatenate((current[bit == 0], current[bit == 1]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][block] + np.bitwise_count(self.words[level][block] & mask)

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` falls in the last level when it follows `symbol`."""
        for level in range(self.bits):
            ones = self._ones(level, at)
            bit = (symbol >> (self.bits - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            bit = ((self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            symbol = symbol * 2 + bit
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling until every rank is unique; the text must end in a separator."""
    n = len(text)
    separator = text == 0
    n_sep = int(separator.sum())
    rank = np.where(separator, np.cumsum(separator) - 1, text.astype(np.int64) + n_sep)
    order = np.argsort(rank, kind="stable")
    step = 0
    while True:
        if step:
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:]
            key = rank * (n + 1) + ahead
            order = np.argsort(key, kind="stable")
        else:
            key = rank
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step = step * 2 or 1


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = 8) -> None:
        order = suffix_array(text)
        self.bwt = WaveletMatrix(text[order - 1].astype(np.int64), max(1, int(n_symbols).bit_length()))
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))))
        every = np.arange(n_symbols + 1)
        self.origin = self.bwt.descend(every, np.zeros(n_symbols + 1, np.int64))
        # text positions that are a multiple of the sample rate or open a run, so that no walk meets a separator
        kept = (order % sample == 0) | (text[order - 1] == 0)
        self.sample_rows = np.flatnonzero(kept)
        self.sample_at = order[kept]

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.smaller[symbol] + self.bwt.descend(symbol, at) - self.origin[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the patterns (one a row, padded on the right)."""
        rows = np.arange(len(patterns))
        symbol = patterns[rows, lengths - 1]
        low, high = self.smaller[symbol].copy(), self.smaller[symbol + 1].copy()
        for back in range(2, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - back]
            low[live] = self._step(symbol, low[live])
            high[live] = self._step(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to a sampled one."""
        found = np.empty(len(rows), np.int64)
        open_, row, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(open_):
            slot = np.searchsorted(self.sample_rows, row)
            hit = (slot < len(self.sample_rows)) & (self.sample_rows[np.minimum(slot, len(self.sample_rows) - 1)] == row)
            found[open_[hit]] = self.sample_at[slot[hit]] + steps
            open_, row = open_[~hit], row[~hit]
            row = self._step(self.bwt.access(row), row)
            steps += 1
        return found
