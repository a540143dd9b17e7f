"""An FM-index over one shard of word numbers: suffix order, wavelet tree, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of `symbols` in order, by prefix doubling. Symbol 0 is a separator; each one differs from all others
    (the earlier is the smaller), so no comparison runs past the end of its stretch."""
    n = len(symbols)
    breaks = symbols == 0
    rank = np.where(breaks, np.cumsum(breaks), int(breaks.sum()) + symbols.astype(np.int64))
    step = 1
    while True:
        key = rank * (n + int(rank.max()) + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Bits:
    """Bit vector with rank: packed words and a running count before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int64)
        self.ones = int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletTree:
    """Ranks and symbols of a sequence; the nodes of one level lie side by side in one bit vector."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.n, self.levels, self.depth = len(sequence), [], max(1, int(symbols - 1).bit_length())
        for at in range(self.depth - 1, -1, -1):
            bits = (sequence >> at) & 1 != 0
            level = Bits(bits)
            self.levels.append((at, level, self.n - level.ones))
            sequence = np.concatenate([sequence[~bits], sequence[bits]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        start = np.zeros_like(i)
        for at, level, zeros in self.levels:
            one = (symbol >> at) & 1 != 0
            a, b = level.rank(i), level.rank(start)
            i, start = np.where(one, zeros + a, i - a), np.where(one, zeros + b, start - b)
        return i - start

    def get(self, i: np.ndarray) -> np.ndarray:
        found = np.zeros(len(i), np.int64)
        for at, level, zeros in self.levels:
            one, a = level.get(i), level.rank(i)
            found |= one.astype(np.int64) << at
            i = np.where(one, zeros + a, i - a)
        return found


class FMIndex:
    """Index of stretches of symbols 1 .. n_symbols-1, parted and ended by 0."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, every: int = 16):
        order = suffix_order(symbols)
        self.tree = WaveletTree(symbols[order - 1].astype(np.int64), n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))]).astype(np.int64)
        # a walk to the left never crosses a separator, so the first place of a stretch is always sampled
        sampled = (order % every == 0) | (symbols[order - 1] == 0)
        self.sampled, self.samples = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase (one phrase per line of the matrix)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.tree.n, np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column].astype(np.int64)
            low[alive] = self.first[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.tree.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row: walk left until a sampled row."""
        found, open_, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(open_):
            at = rows[open_]
            done = self.sampled.get(at)
            found[open_[done]] = self.samples[self.sampled.rank(at[done])] + steps
            open_, at = open_[~done], at[~done]
            if len(open_):
                symbol = self.tree.get(at)
                rows[open_] = self.first[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return found
