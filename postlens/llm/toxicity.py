"""Toxicity by a weighted lexicon: Aho-Corasick over folded text.

Text and lexicon are folded alike: case and accents go, look-alike letters and
digits or signs standing for letters become those letters (i, l, 1, ! and | are
one letter), everything else becomes a blank. A term matches a whole word or,
marked as a stem, the start of one. Hits inside an exception phrase don't
count. The weights of a text's hits, divided by its number of words, give the
score by a logistic curve.

The lexicon is learned from labelled rows: at most ``MAX_TOXIC`` toxic and
``MAX_CLEAN`` other ones, taken by a hash of the id and never from the
held-out fold. A term enters when its share of toxic rows is far above chance.
The curve weighs both classes by their shares of all labelled rows outside the
fold, whatever the bounds left out.

Defined results: null and empty texts have no hit and the lowest score;
repeated rows score alike; without labelled rows the lexicon is empty and the
score 0. Extra columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from postlens.llm.quality import labelled, one_each, stands_for
from postlens.llm.tables import map_rows, stored
from postlens.llm.words import mix64, shingle_set

MAX_TOXIC = 1500
MAX_CLEAN = 4500
MIN_LIKELIHOOD_RATIO = 30.0
MIN_ODDS = 8.0
STEM_LENGTHS = (4, 5, 6)
FOLDS = 5
PREDICT_AT = 0.5

# Letters of other scripts and signs that look like a Latin letter.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "i", "ո": "n", "ս": "u", "α": "a", "β": "b",
    "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a",
    "ɡ": "g", "ɩ": "i", "ʟ": "i", "ᴏ": "o", "ꜱ": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t",
    "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "i", "l": "i",
}

# Phrases in which a listed word is meant harmlessly.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "idiot proof", "sore loser board")


class _Fold(dict):
    """Code point -> folded code point; unknown ones are worked out once."""

    def __missing__(self, code: int) -> int:
        char = chr(code)
        if char in LOOKALIKES:
            out = LOOKALIKES[char]
        else:
            base = unicodedata.normalize("NFKD", char)[0].lower()[0]
            out = LOOKALIKES.get(base, base) if base.isalpha() or base in LOOKALIKES else " "
        self[code] = ord(out)
        return self[code]


_FOLD = _Fold()
_INNER = frozenset("0134578@$!|€£9")


def fold(text: str) -> str:
    """The folded text, one character for each of the text's. Signs and digits at the end of a word are blanks."""
    return text.translate(_FOLD)


def trim_signs(text: str) -> str:
    """Blanks for signs that stand for no letter: words without a letter, and marks around words."""
    return " ".join(w.strip("!|$@€£") if not w.isalpha() else w for w in text.split() if any(map(str.isalpha, w)))


def folded_words(text: str) -> list[str]:
    return fold(trim_signs(text)).split()


@dataclass
class Lexicon:
    """Folded terms with weights; stems match the start of a word."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def matcher(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for terms, close in ((self.stems, ""), (self.words, " ")):
            for term, weight in terms.items():
                automaton.add_word(f" {term}{close}", (len(term) + 1 + len(close), weight))
        for phrase in self.exceptions:
            folded = f" {' '.join(folded_words(phrase))} "
            automaton.add_word(folded, (len(folded), None))
        automaton.make_automaton()
        return automaton


def hits(automaton, words: list[str]) -> list[float]:
    """Weights of the matched words, one each, outside exception phrases."""
    found: dict[int, float] = {}
    covered: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(f" {' '.join(words)} "):
        start = end - length + 1
        if weight is None:
            covered.append((start, end))
        else:
            found[start] = max(weight, found.get(start, weight))
    return [w for at, w in found.items() if not any(a <= at < b for a, b in covered)]


@dataclass
class Model:
    lexicon: Lexicon
    theta: tuple[float, float, float] = (-40.0, 0.0, 0.0)

    def score(self, weights: list[float], n_words: int) -> float:
        x = self.theta[0] + sum(t * v for t, v in zip(self.theta[1:], signals(weights, n_words)))
        return 1.0 / (1.0 + math.exp(-min(max(x, -40.0), 40.0)))


def signals(weights: list[float], n_words: int) -> tuple[float, float]:
    """Weight per thousand words, damped, and whether there is any hit."""
    return math.log1p(1000.0 * sum(weights) / max(n_words, 1)), float(bool(weights))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the bounded sample outside the held-out fold."""
    rows = labelled(labels.where(~held_out()), "toxic").withColumnRenamed("y", "toxic")
    picked = None
    for value, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        part = rows.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    return one_each(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "toxic")


SKETCHES = 4


def _sketches():
    def work(batch: dict) -> dict:
        columns: dict[str, list] = {f"s{k}": [] for k in range(SKETCHES)}
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            marks = shingle_set(text or "")
            for k in range(SKETCHES):
                least = mix64(marks ^ np.uint64(0x5851F42D4C957F2D * (k + 1) % 2**64)).min() if len(marks) else doc_id
                columns[f"s{k}"].append(int(least) >> 1)
        return batch | columns

    return work


def without_copies(sample: DataFrame) -> DataFrame:
    """The sample with one row of those that share a minimum shingle hash, so that copies don't count as evidence."""
    kinds = "doc_id bigint, text string, toxic int, " + ", ".join(f"s{k} bigint" for k in range(SKETCHES))
    ids = map_rows(sample, _sketches, kinds).drop("text")
    for k in range(SKETCHES):
        ids = ids.groupBy(f"s{k}", "toxic").agg(F.min_by(F.struct(*ids.columns), "doc_id").alias("r")).select("r.*")
    return sample.join(F.broadcast(ids.select("doc_id")), "doc_id")


def terms_of(words: list[str]) -> set[str]:
    """Distinct words, each closed by a blank, and their stems."""
    found = set()
    for word in set(words):
        found.add(f"{word} ")
        found.update(word[:n] for n in STEM_LENGTHS if len(word) > n)
    return found


def _term_counts():
    def work(batch: dict) -> dict:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch["text"], batch["toxic"]):
            counts[toxic].update(terms_of(folded_words(text or "")))
        terms = sorted(counts[1])
        return {
            "term": terms + sorted(counts[0].keys() - counts[1].keys()),
            "toxic_rows": [counts[1][t] for t in terms] + [0] * len(counts[0].keys() - counts[1].keys()),
            "clean_rows": [counts[0][t] for t in terms] + [counts[0][t] for t in sorted(counts[0].keys() - counts[1].keys())],
        }

    return work


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> Lexicon:
    """Terms far more frequent in toxic rows; stems only where they gather many words."""
    if not n_toxic or not n_clean:
        return Lexicon()
    counted = map_rows(sample, _term_counts, "term string, toxic_rows bigint, clean_rows bigint")
    totals = counted.groupBy("term").agg(F.sum("toxic_rows").alias("t"), F.sum("clean_rows").alias("c"))
    share = n_toxic / (n_toxic + n_clean)
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    expected = (t + c) * share
    ratio = 2 * (t * F.log(t / expected) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0))
    odds = ((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1))
    strong = totals.where((F.col("t") > 0) & (ratio >= MIN_LIKELIHOOD_RATIO) & (odds >= MIN_ODDS))
    rows = sorted((r["term"], r["t"], r["w"]) for r in strong.select("term", "t", F.log(odds).alias("w")).collect())
    words = {term[:-1]: (n, w) for term, n, w in rows if term.endswith(" ")}
    best: dict[str, int] = {}
    for word, (n, _) in words.items():
        for length in STEM_LENGTHS:
            best[word[:length]] = max(n, best.get(word[:length], 0))
    starts: dict[str, list[tuple[str, int, float]]] = {}
    for term, n, w in rows:
        if not term.endswith(" ") and n >= 2 * best.get(term, 0):
            starts.setdefault(term[: STEM_LENGTHS[0]], []).append((term, n, w))
    stems: dict[str, float] = {}
    for group in starts.values():
        most = max(n for _, n, _ in group)
        term, _, w = max((g for g in group if g[1] >= 0.8 * most), key=lambda g: (len(g[0]), g[1], g[0]))
        stems[term] = w
    covered = {w for w in words if any(w[:n] in stems for n in STEM_LENGTHS)}
    return Lexicon({w: v[1] for w, v in words.items() if w not in covered}, stems)


def _measured(shared):
    def make():
        automaton = shared.value.matcher()

        def work(batch: dict) -> dict:
            density, some = [], []
            for text in batch["text"]:
                words = folded_words(text or "")
                a, b = signals(hits(automaton, words), len(words))
                density.append(a)
                some.append(b)
            return {"toxic": batch["toxic"], "density": density, "some": some}

        return work

    return make


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float, float]:
    """Logistic regression of y over the two signals, lightly damped."""
    weight = np.ones(len(y)) if weight is None else weight * (len(y) / weight.sum())
    design, theta = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    damp = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ theta, -30, 30)))
        step = np.linalg.solve(
            (design * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ design + damp, design.T @ (weight * (p - y)) + damp @ theta
        )
        theta -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, theta))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and curve from the bounded sample; only term counts and two signals a row reach the driver."""
    sample = stored(without_copies(training_rows(docs, labels)), "toxicity-sample")
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    lexicon = learn_lexicon(sample, n_toxic, n_clean)
    if not lexicon.words and not lexicon.stems:
        return Model(lexicon)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = map_rows(sample.select("text", "toxic"), _measured(shared), "toxic int, density double, some double").collect()
    x = np.array([(r["density"], r["some"]) for r in rows])
    y = np.array([r["toxic"] for r in rows])
    weight = np.array(stands_for(labelled(labels.where(~held_out()), "toxic"), (n_clean, n_toxic)))[y]
    return Model(lexicon, fit_curve(x, y.astype(float), weight))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, n_words, n_hits) of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value
        automaton = fitted.lexicon.matcher()

        def work(batch: dict) -> dict:
            out: dict[str, list] = {n: [] for n in ("score", "n_words", "n_hits")}
            for text in batch["text"]:
                words = folded_words(text or "")
                found = hits(automaton, words)
                out["score"].append(fitted.score(found, len(words)))
                out["n_words"].append(len(words))
                out["n_hits"].append(len(found))
            return out | {"doc_id": batch["doc_id"]}

        return work

    scored = map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, score double, n_words bigint, n_hits bigint")
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, at: float = PREDICT_AT) -> DataFrame:
    """The rows of docs below the threshold, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        import pyarrow as pa

        from postlens.llm.tables import slices

        fitted = shared.value
        automaton = fitted.lexicon.matcher()
        for whole in batches:
            for batch in slices(whole):
                kept = []
                for text in batch.column("text").to_pylist():
                    words = folded_words(text or "")
                    kept.append(fitted.score(hits(automaton, words), len(words)) < at)
                yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
