"""Quality rules: base counts of a text and a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word uni- and bigrams and
hashed character trigrams, each kind as shares of the text's own count. It is
fitted on a sample of at most ``MAX_TRAIN`` labelled rows per class, taken by
a hash of the id, and its margin is turned into a probability by a logistic
curve fitted on rows that the fit did not see, weighted so that both classes
have their shares of all labelled rows, whatever the bound left out. Scoring
runs in Arrow batches.

Defined results: a null text counts as empty; a text without words has all
counts zero and fails the base rules; ties, repeated rows and extra columns
change nothing, each row is judged alone and an input column named like an
output column is replaced. With no labelled rows, or rows of one class only,
the model abstains and the base rules alone decide. An empty table gives an
empty table.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from postlens.llm.tables import map_rows
from postlens.llm.words import code_points, segments, windows, words_of

BITS = 15
WIDTH = 1 << BITS
MAX_TRAIN = 1500
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
KEEP_AT = 0.2
ROUNDS = 150
RATE = 0.25
DECAY = 1e-5

COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def repeated_words(text: str, hashes: np.ndarray) -> int:
    """Words inside some 8-word window that occurs at least twice; equal fingerprints are confirmed on the words."""
    marks = windows(hashes, WINDOW)
    if len(marks) < 2:
        return 0
    _, back, count = np.unique(marks, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[back] > 1)
    if not len(at):
        return 0
    words = [w for part in segments(text) for w in plain_words(part)]
    spans = [tuple(words[i : i + WINDOW]) for i in at.tolist()]
    seen = Counter(spans)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i, span in zip(at.tolist(), spans):
        if seen[span] > 1:
            covered[i] += 1
            covered[i + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(covered)[:-1]))


_OTHER = str.maketrans({c: " " for c in "\t\n\v\f\r"})


def plain_words(text: str) -> list[str]:
    return [w for w in text.translate(_OTHER).split(" ") if w]


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = Counter(line for line in text.split("\n") if line.strip(" \t\n\v\f\r"))
    return sum(lines.values()) - len(lines)


def features(text: str, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, shares): every slot of the text's n-grams; each of the three kinds sums to one."""
    shift = np.uint64(64 - BITS)
    kinds = []
    if len(hashes):
        kinds.append((hashes * np.uint64(0x9E3779B97F4A7C15)) >> shift)
    if len(hashes) > 1:
        kinds.append(windows(hashes, 2) >> shift)
    grams = []
    for part in segments(text):
        codes = code_points(part)
        if len(codes) > 2:
            grams.append(
                (
                    codes[:-2] * np.uint32(0x85EBCA6B)
                    + codes[1:-1] * np.uint32(0xC2B2AE35)
                    + codes[2:] * np.uint32(0x27D4EB2F)
                )
                >> np.uint32(32 - BITS)
            )
    if grams:
        kinds.append(np.concatenate(grams))
    if not kinds:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    slots = np.concatenate([k.astype(np.int64) for k in kinds])
    shares = np.concatenate([np.full(len(k), 1.0 / len(k)) for k in kinds])
    return slots, shares


@dataclass
class Model:
    """Margin = bias + sum of weight x share; probability = logistic(slope x margin + shift)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, slots: np.ndarray, shares: np.ndarray) -> float:
        margin = self.bias + float(self.weights[slots].astype(np.float64) @ shares)
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    held: list[tuple[np.ndarray, np.ndarray, int]],
    stands_for: tuple[float, float] = (1.0, 1.0),
) -> Model:
    """Logistic regression by AdaGrad over full passes, then the calibration curve on ``held``.

    A row of class y stands for ``stands_for[y]`` labelled rows in the curve; the fit itself weighs both classes alike.
    """
    size = np.array([len(r[0]) for r in rows])
    row = np.repeat(np.arange(len(rows)), size)
    slots, shares = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    y = np.array([r[2] for r in rows], dtype=np.float64)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    weights, bias, seen, seen_bias = np.zeros(WIDTH), 0.0, np.full(WIDTH, 1e-8), 1e-8
    for _ in range(ROUNDS):
        margin = bias + np.bincount(row, weights[slots] * shares, minlength=len(rows))
        error = balance * (_sigmoid(margin) - y) / len(rows)
        gradient = np.bincount(slots, error[row] * shares, minlength=WIDTH) + DECAY * weights
        seen += gradient**2
        weights -= RATE * gradient / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= RATE * error.sum() / np.sqrt(seen_bias)
    slope, shift = 1.0, 0.0
    if len({r[2] for r in held}) == 2:
        margin = np.array([bias + weights[r[0]] @ r[1] for r in held])
        found = np.array([r[2] for r in held])
        slope, shift = calibrate(margin, found.astype(np.float64), np.array(stands_for)[found])
    return Model(weights.astype(np.float32), float(bias), slope, shift)


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y over the margin, targets smoothed by the class counts."""
    weight = np.ones(len(y)) if weight is None else weight * (len(y) / weight.sum())
    positive, negative = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    scale = max(float(np.abs(margin).max()), 1e-9)
    x, theta = np.stack([margin / scale, np.ones_like(margin)], axis=1), np.zeros(2)
    for _ in range(60):
        p = _sigmoid(x @ theta)
        gradient = x.T @ (weight * (p - target))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        theta -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 0.0) / scale, float(theta[1])


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """Every labelled id once: (doc_id, y)."""
    return labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))


def stands_for(rows: DataFrame, used: tuple[int, int]) -> tuple[float, float]:
    """How many of the labelled rows (doc_id, y) one of the ``used[y]`` rows of a sample stands for, by class."""
    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    return tuple(max(size.get(y, 0) / max(used[y], 1), 1.0) for y in (0, 1))


def one_each(rows: DataFrame, label: str) -> DataFrame:
    """doc_id, text and label of rows(doc_id, text, label), one a doc_id: its least text, so that repeats add nothing."""
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max(label).alias(label))


def sample_of(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` labelled ids of each class, by a hash of the id: (doc_id, y)."""
    rows = labelled(labels, label)
    classes = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    return classes[0].unionByName(classes[1])


def _hashed():
    def work(batch: dict) -> dict:
        slots, shares = [], []
        for text in batch["text"]:
            text = text or ""
            s, v = features(text, words_of(text).hashes)
            used, back = np.unique(s, return_inverse=True)
            slots.append(used.astype("<i4").tobytes())
            shares.append(np.bincount(back, v).astype("<f4").tobytes() if len(used) else b"")
        return {"doc_id": batch["doc_id"], "y": batch["y"], "slots": slots, "shares": shares}

    return work


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model | None:
    """A model from at most ``most`` labelled documents per class; None without rows of both classes.

    Executors turn the sampled texts into hashed shares, at most 2^15 numbers
    a document; only those reach the driver. One row in four is held for the
    calibration.
    """
    picked = F.broadcast(sample_of(labels, "quality", most))
    texts = one_each(docs.select("doc_id", "text").join(picked, "doc_id"), "y")
    found = map_rows(texts, _hashed, "doc_id bigint, y int, slots binary, shares binary")
    rows = sorted(found.collect(), key=lambda r: (r["doc_id"], bytes(r["slots"])))
    if len({r["y"] for r in rows}) < 2:
        return None
    split: tuple[list, list] = ([], [])
    for i, r in enumerate(rows):
        split[i % 4 == 3].append((np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["shares"], "<f4"), r["y"]))
    fitted, held = split
    if len({r[2] for r in fitted}) < 2:
        return None
    used = tuple(sum(r["y"] == y for r in rows) for y in (0, 1))
    return fit(fitted, held, stands_for(labelled(labels, "quality"), used))


def judge(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, base counts, base_failed, quality, kept) of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def work(batch: dict) -> dict:
            out: dict[str, list] = {n: [] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "quality")}
            for text in batch["text"]:
                text = text or ""
                words = words_of(text)
                out["n_words"].append(len(words.hashes))
                out["word_chars"].append(words.word_chars)
                out["n_symbols"].append(words.symbols)
                out["n_dup_lines"].append(repeated_lines(text))
                out["n_repeat_words"].append(repeated_words(text, words.hashes))
                out["quality"].append(fitted.probability(*features(text, words.hashes)) if fitted else None)
            return out | {"doc_id": batch["doc_id"]}

        return work

    scored = map_rows(docs.select("doc_id", "text"), make, f"doc_id bigint, {COUNTS}, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("quality") >= keep_at, F.lit(True))
    )


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that pass, with their columns; each row is judged beside its text, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        import pyarrow as pa

        from postlens.llm.tables import slices

        fitted = shared.value
        for whole in batches:
            for batch in slices(whole):
                kept = [passes(text or "", fitted, keep_at) for text in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def passes(text: str, model: Model | None, keep_at: float = KEEP_AT) -> bool:
    words = words_of(text)
    n = len(words.hashes)
    if n < MIN_WORDS or 100 * repeated_words(text, words.hashes) > REPEAT_PERCENT * n:
        return False
    return model is None or model.probability(*features(text, words.hashes)) >= keep_at
