"""A compressed full-text index over integer sequences: suffix order, BWT in a wavelet matrix, sampled positions.

Symbol 0 separates segments and is never searched for. All operations work on whole numpy arrays, so
that one step of a backward search serves every pattern at once.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with a count before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Rank and access over symbols 0 to sigma - 1."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[BitVector] = []
        self.zeros: list[int] = []
        left = seq.astype(np.uint32)
        for level in reversed(range(self.levels)):
            bit = (left >> np.uint32(level) & np.uint32(1)).astype(bool)
            self.bits.append(BitVector(bit))
            self.zeros.append(len(bit) - int(bit.sum()))
            left = np.concatenate([left[~bit], left[bit]])
        self.first = self.descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            ones = bits.rank(at)
            at = np.where(symbols >> (self.levels - 1 - i) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in front of each position."""
        return self.descend(symbols, at) - self.first[symbols]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands in front."""
        symbols = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            bit, ones = bits.get(at), bits.rank(at)
            symbols = symbols << 1 | bit
            at = np.where(bit, zeros + ones, at - ones)
        return symbols, at - self.first[symbols]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; separators are smallest and differ by position."""
    n, gaps = len(text), text == 0
    rank = text.astype(np.int64) + int(gaps.sum())
    rank[gaps] = np.arange(int(gaps.sum()))
    order = np.argsort(rank, kind="stable")
    step = 0
    while True:
        key = rank if step == 0 else rank * np.int64(n + 1) + np.concatenate([rank[step:] + 1, np.zeros(min(step, n), np.int64)])[:n]
        if step:
            order = np.argsort(key)
        new = np.empty(n, np.int64)
        sorted_key = key[order]
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step = 2 * step or 1


class FMIndex:
    """Backward search and location over a text of symbols 1 to sigma - 1 with 0 after each segment."""

    def __init__(self, text: np.ndarray, sigma: int, every: int = 16):
        order = suffix_order(text)
        bwt = text[order - 1]
        self.n = len(text)
        self.wavelet = WaveletMatrix(bwt, sigma)
        counts = np.bincount(text, minlength=sigma)
        self.less = np.concatenate([[0], np.cumsum(counts)])[:sigma].astype(np.int64)
        sampled = (order % every == 0) | (bwt == 0)
        self.marks, self.samples = BitVector(sampled), order[sampled].astype(np.uint32)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        both = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        base = self.less[symbols]
        return base + both[: len(low)], base + both[len(low) :]

    def search(self, patterns: np.ndarray, lengths: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Intervals (low, high) of the rows of `patterns`; a pattern with under `least` occurrences gets an empty one."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for step in range(int(lengths.max(initial=0))):
            alive = alive[(high[alive] - low[alive] >= least)]
            now = alive[lengths[alive] > step]
            if not len(now):
                break
            low[now], high[now] = self.extend(patterns[now, lengths[now] - 1 - step], low[now], high[now])
        none = high - low < least
        high[none] = low[none]
        return low, high

    def matching(self, texts: np.ndarray, least: int = 2) -> np.ndarray:
        """Matching statistics of the ends of the rows of `texts`: how many symbols, read backwards from there, occur together `least` times or more."""
        low, high = np.zeros(len(texts), np.int64), np.full(len(texts), self.n, np.int64)
        reach, alive = np.zeros(len(texts), np.int64), np.arange(len(texts))
        for step in range(texts.shape[1]):
            low, high = self.extend(texts[alive, texts.shape[1] - 1 - step], low, high)
            held = high - low >= least
            alive, low, high = alive[held], low[held], high[held]
            if not len(alive):
                break
            reach[alive] = step + 1
        return reach

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order, by steps to the next sampled one."""
        out, steps, left, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            found = self.marks.get(at)
            out[left[found]] = self.samples[self.marks.rank(at[found])] + steps
            left, at = left[~found], at[~found]
            if len(left):
                symbols, ranks = self.wavelet.access_rank(at)
                at = self.less[symbols] + ranks
            steps += 1
        return out
