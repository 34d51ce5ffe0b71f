import numpy as np
import pytest

from postlens.llm import coder, tokenfiles, tokens


@pytest.mark.parametrize("n", [1, 2, 7, 2047, 2048, 2049, 5000, 8192])
def test_round_trips(n):
    rng = np.random.default_rng(n)
    for ids in (
        rng.integers(0, 49_408, n), rng.integers(0, 3, n), np.zeros(n, int), np.full(n, 49_407),
        np.repeat(rng.integers(0, 49_408, n // 7 + 1), 7)[:n], np.tile([5, 9, 49_407], n)[:n], np.arange(n) * 5,
    ):
        data = coder.encode(ids)
        assert (coder.decode(data) == ids).all()


def test_blocks_are_independent_and_checked():
    ids = np.random.default_rng(1).integers(0, 300, 5 * coder.BLOCK)
    data = coder.encode(ids)
    assert (coder.decode(data, slice(2, 4)) == ids[2 * coder.BLOCK : 4 * coder.BLOCK]).all()
    broken = bytearray(data)
    broken[-40] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(broken))
    assert (coder.decode(bytes(broken), slice(0, 4)) == ids[: 4 * coder.BLOCK]).all()
    with pytest.raises(ValueError):
        coder.decode(b"XXXX" + data[4:])


def test_context_makes_ids_cheaper():
    rng = np.random.default_rng(4)
    chain = rng.permutation(500)
    ids = np.zeros(4 * coder.BLOCK, dtype=np.int64)
    for i in range(1, len(ids)):
        ids[i] = chain[ids[i - 1]] if rng.random() < 0.9 else rng.integers(0, 500)
    assert len(coder.encode(ids)) < 0.7 * len(coder.encode(rng.permutation(ids)))


def test_files_hold_all_documents_in_order(spark):
    path = tokens.vocabulary_path()
    texts = {9: "Nine nine.", 2: None, 5: "word " * 3000, 7: "", None: "null id", 1: "a b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").selectExpr("*", "1 AS start", "2 AS ids")
    encode, end = tokens.Encoder(path), np.array([1], dtype="<u4").tobytes()
    for segment in (tokenfiles.SEGMENT, 1000):
        files = tokenfiles.write(docs, path, partitions=2, segment=segment)
        rows = sorted(tokenfiles.read(files).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in rows] == [None, 1, 2, 5, 7, 9]
        at = 0
        for r in rows:
            assert r["start"] == at and bytes(r["ids"]) == encode.whole(texts[r["doc_id"]] or "") + end
            at += len(r["ids"]) // 4
    assert tokenfiles.read(tokenfiles.write(docs.limit(0), path)).count() == 0
    same = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "doc_id bigint, text string")
    assert tokenfiles.read(tokenfiles.write(same, path)).count() == 3


def test_kept_chunks_give_the_librarys_ids(monkeypatch):
    texts = [
        "", " ", "Hend, hend. hend", "it's IT'S 'll''s", "a b\tc\r\nd", "1a2b ²½3,4.5", "...!? ,a., (x)",
        "a\x00b \x1cc", "x\x85y", "<|endoftext|> a<|x|>b", "Été ßa µm", "中文 a", "word" * 40 + ", w",
    ]
    for limit in (tokens.CACHED_PIECES, 2):
        monkeypatch.setattr(tokens, "CACHED_PIECES", limit)
        encode = tokens.Encoder(tokens.vocabulary_path())
        for text in texts * 2:
            assert encode.ids(text) == encode.whole(text), text
        assert len(encode.cache) <= limit
