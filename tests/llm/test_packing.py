import random
import zlib

import numpy as np
import pytest

from postlens.llm import packing, tokens


def padding(n, length):
    return 0 if n & (n - 1) == 0 else length - n


def brute_cost(places, penalty, length):
    at, extra = [0, *places], [0, *[p + packing.WINDOW_PRICE for p in penalty]]
    best = [0] + [10**9] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            if at[j] - at[i] <= length:
                best[j] = min(best[j], best[i] + padding(at[j] - at[i], length) + extra[j])
    return best[-1]


@pytest.mark.parametrize("seed", range(12))
def test_cuts_cost_least(seed):
    rng = random.Random(seed)
    length, total = rng.choice([8, 16, 32]), rng.randint(1, 200)
    spots = sorted(rng.sample(range(1, total + 1), rng.randint(1, total)))
    kinds = [rng.random() < 0.5 for _ in spots]
    sentence = np.array([s for s, k in zip(spots, kinds) if k], dtype=np.int64)
    document = np.array([s for s, k in zip(spots, kinds) if not k] + [total], dtype=np.int64)
    places, penalty = packing.candidates(sentence, document, total, length)
    ends = packing.cut(places, penalty, length)
    extra = dict(zip(places.tolist(), penalty.tolist()))
    sizes = np.diff([0, *ends])
    assert ends[-1] == total and sizes.max() <= length
    cost = sum(padding(int(n), length) for n in sizes) + sum(extra[e] + packing.WINDOW_PRICE for e in ends)
    assert np.diff([0, *places]).max() <= length
    assert cost == brute_cost(places.tolist(), penalty.tolist(), length)


TEXTS = [None, "", "Hello world. It's a test!", "x" * 9000, "no end " * 3000, "One. " * 5000] + [f"Doc {i}. Short one." for i in range(300)]


def check(pieces, expected, length):
    sequences, documents = {}, {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
        documents.setdefault(p["doc_id"], []).append(p)
    for group in sequences.values():
        at = 0
        for p in sorted(group, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] == len(p["ids"]) // 4 > 0
            at += p["length"]
        assert at <= length
    assert documents.keys() == expected.keys()
    for doc_id, group in documents.items():
        group.sort(key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in group) == expected[doc_id]
        assert all(p["doc_tokens"] == len(expected[doc_id]) // 4 for p in group)
    return sum(padding(sum(p["length"] for p in g), length) for g in sequences.values())


@pytest.mark.parametrize("length,run", [(4096, 1 << 20), (64, 500)])
def test_every_id_lies_in_one_piece(spark, length, run):
    path = tokens.vocabulary_path()
    encode = tokens.Encoder(path)
    end = np.array([packing.END_ID], dtype="<u4").tobytes()
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").selectExpr("*", "1 AS length", "'a' AS ids")
    pieces = [r.asDict() for r in packing.pack(docs.coalesce(2), path, length, run=run).collect()]
    expected = {i: encode.whole(t or "") + end for i, t in enumerate(TEXTS)}
    pad = check(pieces, expected, length)
    assert pad < 0.02 * sum(p["length"] for p in pieces)


def test_empty_tables_nulls_and_repeats(spark):
    path = tokens.vocabulary_path()
    docs = spark.createDataFrame([(None, "a"), (3, "b c"), (3, "b c")], "doc_id bigint, text string")
    rows = packing.pack(docs, path).collect()
    assert sorted(str(r["doc_id"]) for r in rows if r["start"] == 0) == ["3", "3", "None"]
    assert packing.pack(docs.limit(0), path).count() == 0


def test_encoder_equals_the_library():
    encode = tokens.Encoder(tokens.vocabulary_path())
    rng = random.Random(0)
    signs = "aAbB'sS tT.,!?-_09²½ªºµßÀéÿ÷×\t\n\xa0\xad\x0b\x0c<|>\x85\x1c\x00日Σß don't we've"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|>a", "Σας ΟΔΟΣ", "İstanbul", "", " ", "éa", "word " * 20_000]
    for text in texts:
        assert encode.ids(text) == encode.whole(text), repr(text)[:80]
    assert zlib.crc32(encode.ids("a")) == zlib.crc32(encode.whole("a"))
