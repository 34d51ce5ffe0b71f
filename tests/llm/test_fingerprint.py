import hashlib
import random

import pytest

from postlens.llm import fingerprint as fp


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij é") for _ in range(6)) for _ in range(n))


def plain_triggers(data, least):
    """The same numbers a byte at a time."""
    base, wrap, total, sums, out = fp._BASE, (1 << 64) - 1, 0, [0], []
    for i, byte in enumerate(data):
        total = (total + (byte * 0xD6E8FEB86659FD93 + 0xA0761D6478BD642F) * pow(base, i, 1 << 64)) & wrap
        sums.append(total)
    for end in range(7, len(data) + 1):
        x = (sums[end] - sums[end - 7]) * pow(base, -(end - 7), 1 << 64) & wrap
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & wrap
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & wrap
        x ^= x >> 31
        if x & (least - 1) == least - 1:
            out.append(end)
    return [e for e in out if e < len(data)] + [len(data)]


@pytest.mark.parametrize("segment", [1 << 20, 50])
def test_triggers_and_segments(monkeypatch, segment):
    monkeypatch.setattr(fp, "SEGMENT", segment)
    rng = random.Random(1)
    for n in (1, 5, 7, 8, 300, 999):
        data = bytes(rng.randint(0, 255) for _ in range(n))
        assert fp.triggers(data, 4)[0].tolist() == plain_triggers(data, 4)


def test_segments_give_the_same_fingerprint(monkeypatch):
    text = words(random.Random(2), 3000)
    whole = fp.fingerprint(text)
    monkeypatch.setattr(fp, "SEGMENT", 777)
    assert fp.fingerprint(text) == whole


def test_common_length_equals_table():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 25))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fp.common_length(a, b) == table[-1][-1]


def test_likeness_orders_texts():
    rng = random.Random(4)
    for n in (20, 200, 3000):
        text, other = words(rng, n), words(rng, n)
        near = text.replace(text.split()[n // 2], "changed", 1)
        mark = fp.fingerprint(text)
        assert fp.likeness(mark, fp.fingerprint(text)) == 1
        assert fp.likeness(mark, fp.fingerprint(near)) > 0.7 > 0.3 > fp.likeness(mark, fp.fingerprint(other))
        assert 0.2 < fp.likeness(mark, fp.fingerprint(fp.edited(text, other))) < 0.9
    assert fp.likeness("1:::", fp.fingerprint("a")) == 0 and fp.fingerprint("") == "1:::"
    assert len(fp.fingerprint(words(rng, 100_000)).split(":")[1]) <= fp.MOST


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_all_rows_equal_brute_force(spark, partitions):
    rng = random.Random(5)
    texts = [words(rng, rng.randint(0, 80)) for _ in range(60)] + [None, "", "ab", "ab"]
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").selectExpr("*", "'x' AS fingerprint", "1 AS part")
    got = {r["doc_id"]: r for r in fp.fingerprints(docs, partitions).collect()}
    order = sorted(zip(ids, texts), reverse=True)
    assert len(got) == len(texts)
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        row, mark = got[doc_id], fp.fingerprint(text)
        assert row["n_chars"] == len(text) and row["fingerprint"] == mark
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert row["edited_fingerprint"] == fp.fingerprint(changed)
        assert row["near_edited"] == fp.likeness(mark, fp.fingerprint(changed))
        assert row["near_next"] == fp.likeness(mark, fp.fingerprint(following))


def test_empty_null_and_repeated(spark):
    docs = spark.createDataFrame([(None, "n"), (1, "x"), (1, "x")], "doc_id bigint, text string")
    assert fp.fingerprints(docs).count() == 3
    assert fp.fingerprints(docs.limit(0)).count() == 0
    one = fp.fingerprints(docs.where("doc_id IS NULL")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
