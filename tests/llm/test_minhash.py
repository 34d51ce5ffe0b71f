import random

import numpy as np
import pytest

from postlens.llm import minhash
from postlens.llm.components import components
from postlens.llm.words import shingle_set


def brute(rows):
    """doc_id -> (set size, component) by comparing all pairs of sets of word tuples."""
    import re

    sets = {}
    for doc_id, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x20\x09-\x0d]+", lower)
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def edited(rng, words, share):
    return [f"new{rng.randint(0, 10**9)}" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out, n = [], 0
    for group in range(12):
        words = [f"g{group}w{i}" for i in range(rng.choice([6, 40, 150]))]
        for _ in range(rng.choice([1, 3, 12])):
            out.append((n, " ".join(edited(rng, words, rng.choice([0.0, 0.01, 0.03, 0.05])))))
            n += 1
    base = [f"hot{i}" for i in range(150)]
    for _ in range(120):  # one large group, partly below the threshold to one another
        out.append((n, " ".join(edited(rng, base, rng.choice([0.01, 0.03, 0.06])))))
        n += 1
    for text in ("Alpha Beta", "alpha  beta", "alpha", "", None, " \n ", "one two three four five", "ONE two three four five"):
        out.append((n, text))
        n += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("largest", [12, 2])
def test_classes_equal_brute_force(spark, rows, monkeypatch, largest):
    monkeypatch.setattr(minhash, "PAIRS_UP_TO", largest)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("doc_id", "d").selectExpr("d AS doc_id", "text", "1 AS rep", "2 AS root", "3 AS key")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_classes(docs).collect()}
    assert got == brute(rows)
    kept = {r["doc_id"] for r in minhash.keep_first(docs).collect()}
    assert kept == {d for d, (_, c) in brute(rows).items() if d == c}


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (5, None)], "doc_id bigint, text string")
    rows = sorted(minhash.near_classes(docs).collect(), key=str)
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] == 4] == [(4, 4, True)] * 2
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    assert sorted(str(r["doc_id"]) for r in minhash.keep_first(docs).collect()) == ["4", "5", "None"]
    assert minhash.near_classes(docs.limit(0)).count() == 0


def test_coordinates_meet_at_the_rate_of_similarity():
    rng = np.random.default_rng(2)
    rates = []
    for _ in range(40):
        marks = rng.integers(0, 2**64, 700, dtype=np.uint64)
        a, b = np.unique(marks[:600]), np.unique(marks[100:])
        rates.append(np.mean(minhash.signature(a) == minhash.signature(b)))
    assert abs(np.mean(rates) - 500 / 700) < 0.02


def test_permutation_is_a_bijection():
    values = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65536)
    assert len(np.unique(minhash._permute(values.copy(), 0x2C1B3C6D, 0x297A2D39))) == len(values)


def test_very_long_text_is_one_set():
    assert len(shingle_set(" ".join(str(i) for i in range(400_000)))) == 399_996


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["id"]: r["root"] for r in components(frame).collect()}
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200, 202: 200}
    assert got == want
    assert components(frame.limit(0)).count() == 0


def test_texts_that_share_an_id_all_stay(spark):
    rows = [(1, "one text of some words here"), (1, "a wholly different one with other content"), (1, "one text of some words here"), (2, "third")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.keep_first(docs).collect()) == sorted(set(rows))
