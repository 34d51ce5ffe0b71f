import math
from collections import defaultdict

import pytest

from postlens.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "big" if i % 2 else f"s{i % 7}" if i % 14 else None, 10 + i % 23) for i in range(2000)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").selectExpr("*", "1 AS block", "2 AS size", "3 AS quota")


def sizes(docs):
    found = defaultdict(int)
    for r in docs.collect():
        found[r["source"]] += r["tokens"]
    return found


def test_exponents_meet_their_targets(docs):
    given = docs.selectExpr("source", "tokens")
    sources = mixing.totals(given)
    whole = sizes(docs)
    shares = [v / sum(whole.values()) for v in whole.values()]

    def repeats(a):
        return max(s ** (a - 1) for s in shares) / min(s ** (a - 1) for s in shares)

    def entropy(a):
        z = sum(s**a for s in shares)
        return -sum(s**a / z * math.log(s**a / z) for s in shares)

    a = mixing.bisect_exponent(sources, 2.0)
    assert repeats(a) <= 2 < repeats(a - 1e-6)
    target = (entropy(0) + entropy(1)) / 2
    a = mixing.bisect_exponent(sources, entropy=target)
    assert entropy(a) >= target > entropy(a + 1e-6)
    assert mixing.bisect_exponent(sources, 1e9) == 0.0 and mixing.bisect_exponent(sources, entropy=99.0) == 0.0


def test_no_document_is_lost_and_shares_are_met(docs):
    rows = mixing.mix(docs, tokens="tokens", block_tokens=2000).collect()
    whole, used, seen = sizes(docs), defaultdict(int), defaultdict(set)
    for r in rows:
        used[r["source"]] += r["tokens"]
        seen[r["doc_id"]].add(r["epoch"])
    assert len(seen) == 2000 and sum(len(e) for e in seen.values()) == len(rows)
    assert used["big"] == whole["big"]
    for source, n in whole.items():
        weight = next(r["mix_weight"] for r in rows if r["source"] == source)
        assert abs(used[source] / sum(used.values()) - weight) < 0.01 and n <= used[source] <= 2 * n + 40, source
    blocks = defaultdict(lambda: defaultdict(int))
    for r in rows:
        blocks[r["block"]][r["source"]] += r["tokens"]
    for shares in blocks.values():
        assert abs(shares["big"] / sum(shares.values()) - used["big"] / sum(used.values())) < 0.06


def test_a_budget_takes_the_start_of_each_permutation(docs):
    rows = mixing.mix(docs, tokens="tokens", budget=10_000, block_tokens=1000).collect()
    assert abs(sum(r["tokens"] for r in rows) - 10_000) < 40 * 8 and len({r["doc_id"] for r in rows}) == len(rows)


def test_ranges_give_the_same_order(docs, monkeypatch):
    one = {(r["doc_id"], r["epoch"]): r["place"] for r in mixing.mix(docs, tokens="tokens").collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    many = {(r["doc_id"], r["epoch"]): r["place"] for r in mixing.mix(docs, tokens="tokens").collect()}
    assert one == many


def test_words_nulls_repeats_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, None, None), (None, "a b\n c", "s"), (2, "", "s"), (2, "", "s")], "doc_id bigint, text string, source string")
    rows = mixing.mix(frame).collect()
    assert len([r for r in rows if r["epoch"] == 0]) == 4
    assert frame.select(mixing.n_words().alias("n")).collect() == [(1,), (3,), (1,), (1,)]
    assert mixing.mix(frame.limit(0)).count() == 0
    assert mixing.mixed_documents(frame).columns == frame.columns


def test_columns_named_like_the_mixture_keep_their_values(spark):
    rows = [(i, "some words here", "s", 100 + i, -1.5, "p") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block long, mix_weight double, place string")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} == set(rows)


def plain_mix(rows, exponent, block_tokens, orders):
    """{(doc_id, epoch): (weight, place, block)} by one running sum a source and epoch. rows: (doc_id, source, tokens)."""
    size = defaultdict(int)
    for _, source, tokens in rows:
        size[source] += tokens
    whole = sum(size.values())
    raw = {s: (n / whole) ** exponent for s, n in size.items()}
    scale = max(size[s] / raw[s] for s in size)
    quota = {s: math.floor(raw[s] * scale + 0.5) for s in size}
    n_blocks = max(1, round(sum(quota.values()) / block_tokens))
    out = {}
    for source, limit in quota.items():
        for epoch in range(math.ceil(limit / size[source])):
            begin = epoch * size[source]
            mine = sorted((orders[doc, epoch], doc, tokens) for doc, s, tokens in rows if s == source)
            for _, doc, tokens in mine:
                if begin < limit:
                    place = min((begin + tokens / 2) / limit, 1.0)
                    block = min(math.floor(place * n_blocks), n_blocks - 1)
                    out[doc, epoch] = (raw[source] / sum(raw.values()), place, block)
                begin += tokens
    return out


@pytest.mark.parametrize("range_rows", [2000, 4])
def test_mixture_equals_one_running_sum_a_source(spark, docs, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    given = [(r["doc_id"], r["source"], r["tokens"]) for r in docs.collect()]
    exponent = mixing.bisect_exponent(mixing.totals(docs.selectExpr("coalesce('=' || source, '') AS source", "tokens")))
    ordered = docs.selectExpr("doc_id", "explode(sequence(0, 3)) AS e").selectExpr(
        "doc_id", "e", "shiftrightunsigned(xxhash64(xxhash64(doc_id), e), 1) AS place"
    )
    orders = {(r["doc_id"], r["e"]): r["place"] for r in ordered.collect()}
    want = plain_mix(given, exponent, 1500, orders)
    found = mixing.mix(docs, tokens="tokens", block_tokens=1500).collect()
    got = {(r["doc_id"], r["epoch"]): (r["mix_weight"], r["place"], r["block"]) for r in found}
    assert len(got) == len(found) and set(got) == set(want)
    for copy, (weight, place, block) in want.items():
        assert abs(got[copy][0] - weight) < 1e-12 and abs(got[copy][1] - place) < 1e-12
        assert got[copy][2] == block, copy
    assert len({e for _, e in want}) > 1
