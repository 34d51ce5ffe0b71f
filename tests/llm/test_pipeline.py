import zlib

import numpy as np
import pytest

import corpus_pipeline
from postlens.llm import minhash, packing, quality, tokens, toxicity
from postlens.llm.queries import ORACLES, QUERIES
from postlens.llm.tables import read
from oracle import connect, differences

SMALL = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert not differences(got, connect(SMALL).sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["op2_token_files", "op10_packing"])
def test_token_queries_cover_all_ids(spark, name):
    encode = tokens.Encoder(tokens.vocabulary_path())
    end = np.array([1 if name == "op2_token_files" else packing.END_ID], dtype="<u4").tobytes()
    docs = {r["doc_id"]: encode.whole(r["text"] or "") + end for r in read(spark, SMALL, "documents").collect()}
    rows = sorted(QUERIES[name](spark, SMALL).collect(), key=lambda r: (r["doc_id"], r["start"]))
    if name == "op2_token_files":
        at = 0
        for r in rows:
            ids = docs[r["doc_id"]]
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
            at += len(ids) // 4
        assert len(rows) == len(docs)
    else:
        for r in rows:
            part = docs[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
            assert r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(docs[r["doc_id"]]) // 4
        assert sum(r["length"] for r in rows) == sum(map(len, docs.values())) // 4


def test_stages_equal_their_operators_step_by_step(spark):
    docs = read(spark, SMALL, "documents")
    columns = docs.columns
    labels = read(spark, SMALL, "labels")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.cache()
        docs = stage(spark, before, SMALL).cache()
        got = sorted(r["doc_id"] for r in docs.collect())
        if i == 0:
            rows = quality.judge(before, quality.train(before, labels)).where("kept")
        elif i == 1:
            rows = toxicity.score(before, toxicity.train(before, labels)).where("predicted = 0")
        elif i == 2:
            rows = minhash.near_classes(before).where("kept")
        if i < 3:
            assert got == sorted(r["doc_id"] for r in rows.collect()) and docs.columns == columns
        if i == 3:
            assert set(got) == {r["doc_id"] for r in before.collect()} and docs.columns == columns
        if i == 4:
            texts = before.groupBy("doc_id").count().collect()
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in texts}
            starts = docs.where("start = 0").groupBy("doc_id").count().collect()
            assert {(r["doc_id"], r["count"]) for r in starts} == {(r["doc_id"], r["count"]) for r in texts}


def test_run_over_a_small_folder(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 100
