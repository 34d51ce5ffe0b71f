import hashlib
import random
import re

import numpy as np
import pytest

from oracle import connect, differences
from postlens.llm import decontaminate as dc
from postlens.llm import queries
from postlens.llm.fmindex import Index

SHAPE = "doc_id long, text string, spans string"


def plain_words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def plain(text, items):
    """(n_words, hit places, ids) by comparing every window with every place."""
    words, hit, names = plain_words(text), set(), set()
    for name, item in items:
        own = plain_words(item)
        for at in range(max(1, len(own) - 9) if own else 0):
            window = own[at : at + 10]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    names.add("" if name is None else str(name))
    return len(words), hit, sorted(names)


def test_index_finds_every_place():
    rng = random.Random(1)
    for trial in range(60):
        seqs = [[rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 9))]
        seqs += seqs if trial % 3 == 0 else []
        joined, lengths = np.array([x for s in seqs for x in s]), np.array([len(s) for s in seqs])
        index, base = Index(joined, lengths, 6), np.cumsum(lengths) - lengths
        patterns = [[rng.randint(1, 5) for _ in range(rng.randint(1, 6))] for _ in range(8)]
        rows = np.array([[0] * (6 - len(p)) + p for p in patterns])
        low, high = index.search(rows, np.array([len(p) for p in patterns]))
        for i, p in enumerate(patterns):
            want = [base[k] + a for k, s in enumerate(seqs) for a in range(len(s) - len(p) + 1) if s[a : a + len(p)] == p]
            assert sorted(index.locate(np.arange(low[i], high[i])).tolist()) == sorted(want)


def tables(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "c", "É", "7", "d", "Foo"])
    items = [(i, " ".join(word() for _ in range(rng.choice([12, 10, 4, 3])))) for i in range(12)]
    items += [items[0], (None, "only five words are here"), (50, None), (51, ""), (52, "  ,;")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [items[0][1].upper(), "x " + items[1][1] + ". " + items[1][1], "Only five -- words are here", None, "", " .,"]
    texts += [" ".join(word() for _ in range(3000)) + " " + items[2][1]]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[-2], "x"), (3, items[0][1], "x"), (3, items[0][1], "x")]
    return rows, items


@pytest.mark.parametrize("shard, piece, lot", [(1 << 19, 247, 1 << 19), (40, 13, 7), (90, 1, 100)])
def test_shards_pieces_and_lots(monkeypatch, shard, piece, lot):
    for name, value in (("SHARD", shard), ("PIECE", piece), ("LOT", lot)):
        monkeypatch.setattr(dc, name, value)
    rows, items = tables(shard)
    windows = dc.Windows([("" if i is None else str(i), t) for i, t in items])
    spans, names = dc.search_rows([windows.encode(t) for _, t, _ in rows], windows)
    for (_, text, _), some, ids in zip(rows, spans, names):
        _, hit, want = plain(text, items)
        assert {p for a, b in some.tolist() for p in range(a, b)} == hit and sorted(ids) == want


@pytest.mark.parametrize("block", [1 << 22, 200])
def test_equals_brute_force(spark, block):
    rows, items = tables(2)
    found = dc.find(spark.createDataFrame(rows, SHAPE), spark.createDataFrame(items, "item_id long, text string"), block)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in dc.report(found).collect()]
    want = []
    for doc, text, _ in rows:
        n, hit, names = plain(text, items)
        want.append((doc, n, len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.report(dc.find(docs.limit(0), items)).count() == 0
    row = dc.report(dc.find(docs, items.limit(0))).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (3, 0, False)


def test_segments_cut_between_words(monkeypatch):
    text = "Alpha béta  gamma-delta " * 50
    monkeypatch.setattr(dc, "SEGMENT", 7)
    assert [w.decode() for part in dc.words_of(text) for w in part] == plain_words(text)


def test_cleaned_text(spark):
    docs = spark.createDataFrame([(1, "Keep this. Only five, WORDS are here! And this."), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "only five words are here")], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dc.cleaned(docs, items).collect()}
    assert got == {1: "Keep this. ! And this.", 2: None}


def test_query_equals_its_sql(spark):
    name, small = "op11_benchmark_decontamination", "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, small).toPandas()
    assert got["contaminated"].any()
    assert not differences(got, connect(small).sql(queries.ORACLES[name]).df())
