"""FM-index of a shard of symbol sequences: suffix order, wavelet levels, backward search, sampled positions.

Symbol 0 ends a sequence. The index is built and asked with numpy, all
patterns at once; a shard has at most ``MOST`` symbols, so that three
positions fit in one 64-bit key of a sort.
"""

from __future__ import annotations

import numpy as np

MOST = 1 << 21
SAMPLE = 16
_ONE = np.uint64(1)


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; ``left`` is each position's distance to the end of its sequence.

    Prefix doubling on packed keys. A suffix ends with its sequence, equal
    ones are ordered by position, so the number of rounds is the logarithm of
    the longest sequence, however many copies there are.
    """
    n = len(symbols)
    place_bits = max(1, n.bit_length())
    symbol_bits = max(1, int(symbols.max()).bit_length())
    known = max(1, (64 - place_bits) // symbol_bits)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(known):
        key <<= np.uint64(symbol_bits)
        if j < n:
            inside = left[: n - j] >= j
            key[: n - j] |= np.where(inside, symbols[j:], 0).astype(np.uint64)
    shift, low = np.uint64(place_bits), np.uint64((1 << place_bits) - 1)
    packed = np.sort(key << shift | np.arange(n, dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    key = packed >> shift
    first = np.ones(n + 1, dtype=bool)
    first[1:n] = (key[1:] != key[:-1]) | (left[order[1:]] < known)
    rank = np.empty(n, dtype=np.uint64)
    starts = np.flatnonzero(first[:n])
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n))).astype(np.uint64)
    while True:
        slots = np.flatnonzero(~(first[:n] & first[1:]))
        if not len(slots):
            return order
        at = order[slots].astype(np.uint64)
        packed = np.sort((rank[order[slots]] << shift | rank[order[slots] + known]) << shift | at)
        at = (packed & low).astype(np.int64)
        key = packed >> shift
        known *= 2
        order[slots] = at
        fresh = np.ones(len(slots), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (left[at[1:]] < known)
        first[slots] = fresh
        begin = np.flatnonzero(fresh)
        rank[at] = np.repeat(slots[begin], np.diff(np.append(begin, len(slots)))).astype(np.uint64)


class Wavelet:
    """Bit planes of a sequence, highest bit first, each plane ordered by the planes above it."""

    def __init__(self, values: np.ndarray, size: int):
        self.bits = max(1, (size - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = values.astype(np.uint16 if size <= 1 << 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            ones = (now >> level & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(packed) // 8 + 2, dtype=np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.zeros(len(words) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(len(now) - int(counts[-1]))
            now = np.concatenate([now[~ones], now[ones]])
        self.starts = np.zeros(size, dtype=np.int64)
        self.starts = self.push(np.arange(size), np.zeros(size, dtype=np.int64))

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def push(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each value's occurrences before its place (counted from where the value's own run starts)."""
        for level in range(self.bits):
            ones = self._rank(level, at)
            high = (values >> (self.bits - 1 - level) & 1).astype(bool)
            at = np.where(high, self.zeros[level] + ones, at - ones)
        return at - self.starts[values]

    def value_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at each place and its occurrences before that place."""
        values = np.zeros(len(at), dtype=np.int64)
        for level in range(self.bits):
            ones = self._rank(level, at)
            high = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64) & _ONE).astype(bool)
            values = values << 1 | high
            at = np.where(high, self.zeros[level] + ones, at - ones)
        return values, at - self.starts[values]


class Index:
    """Counts and places of patterns in sequences given as lengths and their joined symbols (each from 1 on)."""

    def __init__(self, joined: np.ndarray, lengths: np.ndarray, size: int):
        """``size`` is one more than the largest symbol; every sequence is closed by a 0 of its own here."""
        whole = lengths + 1
        begin = np.cumsum(whole) - whole
        n = int(whole.sum())
        if n > MOST:
            raise ValueError(f"{n} symbols in one shard")
        within = np.arange(n) - np.repeat(begin, whole)
        left = np.repeat(lengths, whole) - within
        symbols = np.zeros(n, dtype=np.int64)
        symbols[left > 0] = joined
        order = suffix_order(symbols, left)
        self.before = np.zeros(size + 1, dtype=np.int64)
        np.cumsum(np.bincount(symbols, minlength=size), out=self.before[1:])
        self.wavelet = Wavelet(symbols[order - 1], size)
        sampled = within[order] % SAMPLE == 0
        self.marks = sampled
        self.places = np.cumsum(sampled) - 1
        self.samples = order[sampled]
        self.n, self.begin = n, begin

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows whose suffixes start with each pattern (right-aligned rows of symbols, 0 where none)."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        width = patterns.shape[1]
        alive = np.arange(len(patterns))
        for step in range(width):
            alive = alive[(lengths[alive] > step) & (low[alive] < high[alive])]
            if not len(alive):
                break
            symbol = patterns[alive, width - 1 - step]
            low[alive] = self.before[symbol] + self.wavelet.push(symbol, low[alive])
            high[alive] = self.before[symbol] + self.wavelet.push(symbol, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the joined symbols of the suffixes in these rows: steps back to the next sampled one."""
        found = np.empty(len(rows), dtype=np.int64)
        waiting, now, steps = np.arange(len(rows)), rows, 0
        while len(waiting):
            hit = self.marks[now]
            found[waiting[hit]] = self.samples[self.places[now[hit]]] + steps
            waiting, now = waiting[~hit], now[~hit]
            symbol, rank = self.wavelet.value_and_rank(now)
            now = self.before[symbol] + rank
            steps += 1
        return found - (np.searchsorted(self.begin, found, side="right") - 1)
