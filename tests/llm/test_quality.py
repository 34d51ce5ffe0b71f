import random
import re
from collections import Counter

import numpy as np
import pytest

from postlens.llm import quality
from postlens.llm.words import shingle_set, windows, words_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    spans = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if spans[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


TEXTS = [
    None, "", " \n\t ", "a", "one two\none two\n\none two", "x " * 40, "# * $ % & | < > é　b\x1cc\xa0d",
    "\n".join(["the same line of eight words comes again here"] * 5), " ".join(f"w{i}" for i in range(500)),
]


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts.append(" ".join(str(rng.randint(0, 50_000)) for _ in range(60_000)))  # very long
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in quality.judge(docs, None).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, text in enumerate(texts):
        assert tuple(got[i][n] for n in names) == brute(text), repr(text)[:80]
        assert got[i]["kept"] == (not got[i]["base_failed"])


def test_segments_do_not_change_words(monkeypatch):
    text = " ".join(f"word{i % 37}" for i in range(3000))
    whole = words_of(text).hashes
    monkeypatch.setattr("postlens.llm.words.segments.__defaults__", (100,))
    assert (words_of(text).hashes == whole).all()


def test_equal_words_have_equal_fingerprints_at_any_place():
    hashes = words_of("alpha beta alpha\ngamma alpha").hashes
    assert hashes[0] == hashes[2] == hashes[4] and len(set(hashes.tolist())) == 3
    assert len(windows(hashes, 6)) == 0


def test_shingles_of_short_texts():
    assert len(shingle_set("")) == 0 and len(shingle_set("a b")) == 1
    assert (shingle_set("A B") == shingle_set("a  b")).all() and shingle_set("a b")[0] != shingle_set("a b c")[0]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        good = i % 2
        words = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(60)]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!$$" for w in words)))
        labels.append((i, good, 0))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(
        labels, "doc_id bigint, quality int, toxic int"
    )


def test_model_separates_held_out_rows(labelled):
    docs, labels = labelled
    model = quality.train(docs, labels.where("doc_id < 200"))
    rows = quality.judge(docs.where("doc_id >= 200"), model).collect()
    assert all(r["kept"] == bool(r["doc_id"] % 2) for r in rows) and len(rows) == 100
    kept = quality.keep_good(docs.withColumn("quality", docs["doc_id"]), labels)
    assert kept.columns == ["doc_id", "text", "quality"] and kept.where("doc_id % 2 = 0").count() == 0


def test_calibration_follows_the_shares():
    rng = np.random.default_rng(0)
    margin = rng.normal(size=4000) * 3
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.7 * margin - 0.5)))).astype(float)
    slope, shift = quality.calibrate(margin, y)
    assert abs(slope - 0.7) < 0.1 and abs(shift + 0.5) < 0.15


def test_without_labels_the_base_rules_decide(spark, labelled):
    docs, labels = labelled
    assert quality.train(docs, labels.where("quality = 1")) is None
    assert quality.train(docs, labels.limit(0)) is None
    nulls = labels.selectExpr("CAST(NULL AS BIGINT) doc_id", "CAST(NULL AS INT) quality", "toxic")
    assert quality.train(docs, nulls) is None
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_verdicts_do_not_shift_with_the_cap(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1400):
        good = i % 7 > 0
        kind = good if rng.random() < 0.85 else not good
        words = [rng.choice("abcdefgh" if kind == (rng.random() < 0.8) else "nopqrstu") * 3 for _ in range(40)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").cache()
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    free, capped = quality.train(docs, frame), quality.train(docs, frame, 200)
    marks = [quality.features(text, words_of(text).hashes) for _, text in rows]
    p, q = (np.array([m.probability(*f) for f in marks]) for m in (free, capped))
    good = np.array([y for _, y, _ in labels])
    assert abs(p.mean() - good.mean()) < 0.05 and abs(q.mean() - good.mean()) < 0.05
    assert np.mean((p >= quality.KEEP_AT) != (q >= quality.KEEP_AT)) < 0.05


def test_weighted_calibration_gives_the_shares_back():
    rng = np.random.default_rng(0)
    y = (rng.random(70_000) < 6 / 7).astype(float)
    margin = rng.normal(size=len(y)) + y
    part = np.sort(np.concatenate([np.flatnonzero(y == 1)[:9000], np.flatnonzero(y == 0)[:9000]]))
    weight = np.where(y[part] == 1, (y == 1).sum() / 9000, (y == 0).sum() / 9000)
    whole, sampled = quality.calibrate(margin, y), quality.calibrate(margin[part], y[part], weight)
    assert abs(whole[0] - sampled[0]) < 0.1 and abs(whole[1] - sampled[1]) < 0.1


def test_repeated_ids_do_not_widen_the_sample(spark, monkeypatch):
    rows = [(1, f"bad words again {i}") for i in range(500)] + [(2, "good words of another kind")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    picked = quality.sample_of(labels, "quality", 10)
    assert quality.one_each(docs.join(picked, "doc_id"), "y").count() == 2
    assert quality.stands_for(picked, (1, 0)) == (1.0, 1.0)
