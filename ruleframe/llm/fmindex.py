"""FM-index of a sequence of word ids: wavelet matrix over the BWT, sampled suffix positions.

Id 0 is a separator.  Each separator counts as a symbol of its own, ordered
by position, so suffixes never compare past one; runs of them may be given as
a single one.  All queries are vectorized over many patterns or rows.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of ids; ``text`` ends with a separator."""
    n = len(text)
    gaps = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + (len(gaps) - 1)
    rank[gaps] = np.arange(len(gaps))
    bits = int(rank.max()).bit_length()
    depth = max(1, 62 // max(1, bits))
    padded = np.concatenate([rank, np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = key << bits | padded[k:k + n]
    order = np.argsort(key)
    key = key[order]
    starts = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    slots = np.flatnonzero(~(starts & np.concatenate([starts[1:], [True]])))  # places not decided yet
    while len(slots):
        # a suffix that is still tied has no separator in its first `depth` symbols, so it goes on
        rows = order[slots]
        key = rank[rows] * n + rank[rows + depth]
        sort = np.argsort(key)
        rows, key = rows[sort], key[sort]
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        first = slots[np.maximum.accumulate(np.where(starts, np.arange(len(slots)), 0))]
        order[slots] = rows
        rank[rows] = first
        slots = slots[~(starts & np.concatenate([starts[1:], [True]]))]
        depth *= 2
    return order


class Bits:
    """Bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((len(packed) // 8 + 1) * 8, np.uint8)
        padded[:len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16):
        """``text``: ids below ``symbols``, ending with a separator; every ``sample``-th position is kept."""
        self.n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]  # position -1 is the closing separator
        counts = np.bincount(text, minlength=symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.levels, self.zeros = [], []
        sequence = bwt
        for level in reversed(range(max(1, (symbols - 1).bit_length()))):
            ones = (sequence >> level & 1).astype(bool)
            self.levels.append((level, Bits(ones)))
            self.zeros.append(self.n - int(ones.sum()))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        every = np.arange(symbols)
        self.base = self._down(every, np.zeros(symbols, np.int64))
        # a walk ends at a sample; positions after a separator are samples, so no walk crosses one
        kept = (order % sample == 0) | (bwt == 0)
        self.sampled, self.samples = Bits(kept), order[kept]

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for (level, bits), zeros in zip(self.levels, self.zeros):
            ones = bits.rank(i)
            i = np.where(symbol >> level & 1, zeros + ones, i - ones)
        return i

    def occurrences(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before place i of the BWT."""
        return self._down(symbol, i) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of equally long patterns (one a row), by backward search."""
        last = patterns[:, -1]
        low, high = self.first[last], self.first[last + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            c = patterns[live, k]
            low[live] = self.first[c] + self.occurrences(c, low[live])
            high[live] = self.first[c] + self.occurrences(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of places in the suffix order, by walking to the nearest sample."""
        out, steps = np.empty(len(rows), np.int64), 0
        todo, at = np.arange(len(rows)), rows
        while len(todo):
            done = self.sampled.get(at)
            out[todo[done]] = self.samples[self.sampled.rank(at[done])] + steps
            todo, at = todo[~done], at[~done]
            if not len(todo):
                break
            i, c = at, np.zeros(len(at), np.int64)
            for (level, bits), zeros in zip(self.levels, self.zeros):
                one, ones = bits.get(i), bits.rank(i)
                c |= one.astype(np.int64) << level
                i = np.where(one, zeros + ones, i - ones)
            at = self.first[c] + i - self.base[c]
            steps += 1
        return out
