"""Words of a text and their 64-bit fingerprints, computed by numpy inside tasks.

A word is a run of characters other than ``\\x20`` and ``\\x09-\\x0D``. A text
is handled in segments that end between words, so that the arrays stay small
for very long texts too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SYMBOLS = np.zeros(128, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_SPACES = np.zeros(128, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of values[j] * base^j for j < i, modulo 2^64."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0], dtype=np.uint64, out=sums[1:])
    return sums


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def segments(text: str, size: int = SEGMENT):
    """The text in parts of about ``size`` characters, cut only next to a separator."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and text[end] not in " \t\n\v\f\r":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


@dataclass
class Words:
    hashes: np.ndarray
    word_chars: int
    symbols: int


def words_of(text: str, fold: bool = False) -> Words:
    """Fingerprints of the words in order; ``fold`` lower-cases A-Z first."""
    found, chars, symbols = [], 0, 0
    for part in segments(text):
        codes = code_points(part)
        small = np.minimum(codes, 127)
        space = _SPACES[small] & (codes < 127)
        symbols += int(np.count_nonzero(_SYMBOLS[small] & (codes < 127)))
        if fold:
            codes = np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        chars += int((ends - starts).sum())
        if len(starts):
            values = codes.astype(np.uint64)
            values *= np.uint64(0xD6E8FEB86659FD93)
            values += np.uint64(0xA0761D6478BD642F)
            sums = prefix_sums(values)
            found.append(mix64((sums[ends] - sums[starts]) * powers(len(codes))[1][starts]))
    return Words(np.concatenate(found) if found else np.zeros(0, dtype=np.uint64), chars, symbols)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of every run of ``width`` words, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        total *= np.uint64(0xC2B2AE3D27D4EB4F)
        total += hashes[i : i + n]
    return mix64(total)


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct word shingles; a text of fewer words is one shingle, one without words none."""
    hashes = words_of(text, fold=True).hashes
    if not len(hashes):
        return hashes
    if len(hashes) < width:
        short = hashes + np.uint64(len(hashes))
        return windows(short, len(short))
    return np.unique(windows(hashes, width))
