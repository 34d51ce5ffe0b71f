"""Words of texts without blanks: the best path through the lattice of all dictionary words.

The dictionary lies in a double-array trie (Aoe, IEEE TSE 1989): two number
arrays, one step a character. From the end of a run backwards, each place
takes the word after which the rest is likeliest; a character that starts no
word stands alone. Runs of Latin letters and digits are one token.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

ALNUM = re.compile(r"[A-Za-z0-9]+")


class Trie:
    """Terms with frequencies as a double array: state t follows s by character c where base[s] + c = t and check[t] = s."""

    def __init__(self, frequencies: dict[str, float]):
        terms = {t: float(f) for t, f in frequencies.items() if t and f > 0}
        letters = sorted({c for t in terms for c in t})
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        total = sum(terms.values()) or 1.0
        self.unknown = -math.log(total)  # as rare as a word seen once
        size = 4 * (sum(map(len, terms)) + len(letters) + 2)
        base, check = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        weight = np.full(size, np.nan)
        check[0], free = 0, 1
        level: list[tuple[int, list[str], int]] = [(0, sorted(terms), 0)]
        while level:
            state, group, depth = level.pop()
            if len(group[0]) == depth:
                weight[state] = math.log(terms[group[0]] / total)
                group = group[1:]
            children: dict[str, list[str]] = {}
            for term in group:
                children.setdefault(term[depth], []).append(term)
            if not children:
                continue
            codes = np.array([self.code[c] for c in children])
            while free < len(check) and check[free] >= 0:
                free += 1
            start = max(1, free - int(codes.min()))
            while start + codes.max() >= len(check) or (check[start + codes] >= 0).any():
                if start + codes.max() >= len(check):
                    grown = len(check)
                    base = np.append(base, np.zeros(grown, dtype=np.int64))
                    check = np.append(check, np.full(grown, -1, dtype=np.int64))
                    weight = np.append(weight, np.full(grown, np.nan))
                else:
                    start += 1
            base[state] = start
            check[start + codes] = state
            level += [(start + self.code[c], terms_, depth + 1) for c, terms_ in children.items()]
        self.base, self.check = base.tolist(), check.tolist()
        self.weight = [None if math.isnan(w) else w for w in weight.tolist()]

    def words_at(self, codes: list[int], start: int) -> Iterator[tuple[int, float]]:
        """(end, log frequency) of every word that starts here."""
        state, base, check, weight = 0, self.base, self.check, self.weight
        for at in range(start, len(codes)):
            following = base[state] + codes[at]
            if not codes[at] or not base[state] or following >= len(check) or check[following] != state:
                return
            state = following
            if weight[state] is not None:
                yield at + 1, weight[state]

    def best(self, run: str) -> list[str]:
        """The words of the likeliest path; of equal ones the path whose first word is longest."""
        codes = [self.code.get(c, 0) for c in run]
        n = len(codes)
        score, step = [0.0] * (n + 1), [0] * (n + 1)
        for at in range(n - 1, -1, -1):
            top, end = self.unknown + score[at + 1], at + 1
            for stop, weight in self.words_at(codes, at):
                if weight + score[stop] >= top:
                    top, end = weight + score[stop], stop
            score[at], step[at] = top, end
        out, at = [], 0
        while at < n:
            out.append(run[at : step[at]])
            at = step[at]
        return out

    def tokens(self, text: str) -> list[str]:
        out, at = [], 0
        for found in ALNUM.finditer(text):
            out += self.best(text[at : found.start()])
            out.append(found.group())
            at = found.end()
        return out + self.best(text[at:])


def segment(text: Column, frequencies: dict[str, float]) -> Column:
    """Tokens of a text column by the best path; null stays null. The trie is built once in each Python worker's task."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = Trie(frequencies)
        for texts in parts:
            yield pd.Series([None if t is None else trie.tokens(t) for t in texts], dtype=object)

    return run(text)
