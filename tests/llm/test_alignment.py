import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from postlens.llm import alignment as al, queries, tokens

A, B = tokens.vocabulary_path(al.A_FILE), tokens.vocabulary_path(al.B_FILE)


@pytest.fixture(scope="module")
def plain():
    """Whole texts by both libraries: (ids and bytes of each token) by A and by B, or None where the bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    alphabet = {c: b for b, c in tokens.byte_alphabet().items()}
    names = {i: bytes(alphabet[c] for c in t) for t, i in json.loads(a.to_str())["model"]["vocab"].items()}
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def encode(text):
        if not text:
            return None
        x = [(i, names[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, piece(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (x, y) if b"".join(p for _, p in x) == whole == b"".join(p for _, p in y) else None

    return encode


def groups(x, y):
    def ends(tokens):
        at, out = 0, []
        for _, data in tokens:
            at += len(data)
            out.append(at)
        return out

    ex, ey = ends(x), ends(y)
    common, out, low = sorted(set(ex) & set(ey)), [], 0
    for stop in common:
        out.append(([i for (i, _), e in zip(x, ex) if low < e <= stop], [i for (i, _), e in zip(y, ey) if low < e <= stop]))
        low = stop
    return out


def expected(rows, encode):
    found, corpus = [], Counter()
    for doc, text in rows:
        both = encode(text)
        cut = groups(*both) if both else []
        links = Counter((a, b) for left, right in cut for a in left for b in right)
        corpus.update(links.keys())
        found.append((doc, both, cut, links))
    best = defaultdict(int)
    for (a, _), n in corpus.items():
        best[a] = max(best[a], n)
    out = []
    for doc, both, cut, links in found:
        shown = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in cut)
        out.append((doc, len(both[0]) if both else 0, len(both[1]) if both else 0, len(cut), sum(links.values()),
                    sum(n for p, n in links.items() if corpus[p] == best[p[0]]), sum(n * corpus[p] for p, n in links.items()),
                    hashlib.sha256(shown.encode()).hexdigest() if cut else ""))
    return out, corpus, sum((f[3] for f in found), Counter())


def texts():
    rng = random.Random(7)
    words = ["the", "Straße", "naïve", "don't", "  two", "\n", "\nline", "\t tab", "x\r\n", "42", "3.14", "日本語", "😀😀", "<s>", "</s>", "<0x0A>",
             "<|endoftext|>", "antidisestablishment", "ñandú", "a b", "aaaaaaaaaaaa", "--", "…", "\u0085", "é"]
    out = [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    out += [" ".join(rng.choice(words) for _ in range(25)) + rng.choice(["", " ", "\n\n", "  \t"]) for _ in range(40)]
    out += [None, "", " ", "\n", "   ", "has ▁ mark", "nul \x00 here", "a", "A" * 5000, "ab" * 3000, "word " * 3000]
    return out


def rows_of(df):
    return sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
                   for r in df.collect()), key=str)


def test_equals_brute_force(spark, plain):
    rows = list(enumerate(texts())) + [(3, texts()[3]), (3, texts()[3]), (None, "null id")]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, pair string, block int").repartition(5)
    want, corpus, links = expected(rows, plain)
    assert rows_of(al.align(df, A, B)) == sorted(want, key=str)
    assert sum(not w[1] for w in want) == 3  # null, empty, the mark
    table = al.pair_counts(al.inverted(df, A, B)).collect()
    assert {(r["a"], r["b"]): r["n_docs"] for r in table} == dict(corpus)
    assert {(r["a"], r["b"]): r["n_links"] for r in table} == dict(links)


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert al.align(df.limit(0), A, B).count() == 0


def test_blocks_give_the_same_bitmaps(plain):
    """Small blocks, a small cache and wide groups by way of distinct ids change nothing."""
    def pairs(limit):
        counts, ag = Counter(), al.Aligner(al.vocabularies(A, B))
        some = [t for t in texts() if t]
        for at in range(0, len(some), limit):
            block = al.Block(ag, at)
            block.add(list(range(limit)), some[at : at + limit])
            for pair, place, times in zip(*al.postings(block.documents, ag)):
                counts[int(pair)] += int(times)
        return counts

    whole = pairs(1000)
    assert pairs(3) == whole
    wide, al.WIDE = al.WIDE, 4
    try:
        assert pairs(50) == whole
    finally:
        al.WIDE = wide


def test_bitmaps_round_trip():
    rng = np.random.default_rng(1)
    for size in (1, 7, 8, 500, 9000):
        sets = [np.sort(rng.choice(size, rng.integers(1, size + 1), replace=False)) for _ in range(40)]
        ends = np.cumsum([len(s) for s in sets])
        docs, dense = al.containers(np.concatenate(sets), ends, size)
        row, place = al.opened(docs, dense)
        assert all(sorted(place[row == i].tolist()) == s.tolist() for i, s in enumerate(sets))
        assert dense.any() or size < 10


def test_query_equals_brute_force(spark, plain):
    small = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(queries.QUERIES["op12_cross_tokenizer_alignment"](spark, small))
    assert got == sorted(expected(rows, plain)[0], key=str)
