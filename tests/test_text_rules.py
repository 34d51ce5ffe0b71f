"""Rules on text, encodings, tiers and streams on small hand-made posts."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.operators import clean, eda, prepare, reshape, sentiment, topics
from postlens.functions.quantiles import quantiles, top_share
from postlens.seeds import patterns as P, words as W
from postlens.sources import readers


def column(spark, texts, make):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["out"] for r in frame.select("i", make(F.col("text")).alias("out")).orderBy("i").collect()]


def test_normalisation_of_odd_texts(spark):
    texts = [None, "", "  ", "　", "wow!!!!", "RT: hi", "ＲＴ hi", "＠user hi", "＃tag", "see http://a.b/c now", "好。。。。", "hi 😀"]
    out = column(spark, texts, T.normalize)
    assert out[:4] == ["", "", "", ""] and out[4] == "wow!!" and out[5] == "hi"
    assert out[7] == "hi" and out[8] == "tag" and out[9] == "see now" and out[10] == "好。。" and out[11] == "hi 😀"


def test_scripts(spark):
    out = column(spark, ["說話的時間", "说话的时间", "hello there", "ab", None], T.script_language)
    assert out == ["zh-TW", "zh", "auto", "auto", "auto"]


@pytest.mark.parametrize("language,words", [("zh-TW", W.ZH_TW_POSITIVE), ("zh-TW", W.ZH_TW_NEGATIVE), ("en", W.EN_POSITIVE), ("en", W.EN_NEGATIVE)])
def test_every_shipped_word_has_its_sign(spark, language, words):
    single = [w for w in words if " " not in w]
    frame = spark.createDataFrame([(w, w) for w in single], "id string, text string")
    rows = sentiment.label_posts(prepare.prepare_posts(frame, language)).collect()
    wrong = [r["id"] for r in rows if (r["t2_label"] == "POSITIVE") != (words[r["id"]] > 0) and r["t2_label"] != "NEUTRAL"]
    assert not wrong and sum(r["t2_label"] != "NEUTRAL" for r in rows) > 0.8 * len(single)


def test_dictionary_keeps_whole_words(spark):
    frame = spark.createDataFrame([("1", "颱風過後感激不盡")], "id string, text string")
    tokens = prepare.prepare_posts(frame, "zh-TW").first()["tokens"]
    assert "颱風" in tokens and "感激不盡" in tokens


def test_negation_within_two_words(spark):
    word = next(w for w, n in W.EN_POSITIVE.items() if n == 1 and " " not in w)
    texts = [f"not {word}", f"not very {word}", f"not so very {word}", f"never not {word}", word]
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    rows = sentiment.label_posts(prepare.prepare_posts(frame, "en")).orderBy("id").collect()
    signs = [r["t2_label"] for r in rows]
    assert signs[0] == signs[1] == "NEGATIVE" and signs[2] == signs[4] == "POSITIVE"


def test_tier_grid_is_total_and_keeps_its_promises(spark):
    confidences = [0.05, 0.3, 0.55, 0.65, 0.7, 1.0]
    rows = list(itertools.product(P.LABELS, P.LABELS, confidences, confidences))
    frame = spark.createDataFrame(rows, "a string, b string, x double, y double")
    out = frame.withColumn("r", sentiment.combine_tiers(F.col("a"), F.col("b"), F.col("x"), F.col("y"))).collect()
    assert len(out) == len(P.LABELS) ** 2 * 36
    for r in out:
        final = r["r"]["label"] if "label" in r["r"].asDict() else r["r"][0]
        assert final in P.LABELS
        if "UNCERTAIN" in (r["a"], r["b"]):
            assert final == "UNCERTAIN"
        elif r["a"] == r["b"]:
            assert final == r["a"]
        elif r["a"] == "NEGATIVE-DISTRESS":
            assert final == r["a"]


def test_streams_of_nine_rows(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(f"{i}", f"text {i}", day, "user", 1.0, "x") for i in range(6)]
    rows += [("0", "again", day, "user", 1.0, "x"), ("7", " ", day, "user", 1.0, "x"), ("8", "beep", day, "bot", 1.0, "x")]
    posts = spark.createDataFrame(rows, "id string, text string, ts timestamp, author string, engagement double, platform string")
    assert eda.composite_dup_count(posts).first()[0] == 1 and eda.empty_text_count(posts).first()[0] == 1
    streams = {r["stream"]: r["count"] for r in clean.clean_posts(posts, ["bot"]).groupBy("stream").count().collect()}
    assert streams == {"organic": 6, "quarantine": 1, "bots": 1}


def test_keys_with_separators_stay_apart(spark):
    rows = [("b|c", "t", "a"), ("c", "u", "a|b"), (None, "v", "a"), (None, "w", "a")]
    posts = spark.createDataFrame(rows, "id string, text string, platform string")
    assert eda.composite_dup_count(posts).first()[0] in (0, 1)
    assert clean.clean_posts(posts.withColumn("author", F.lit("x")), ["bot"]).where("stream = 'organic'").count() == 4


@pytest.mark.parametrize("encoding,text", [("utf-8-sig", "id,text\n1,感謝\n"), ("cp950", "id,text\n1,感謝\n"), ("utf-8", "id,text\n1,N/A\n")])
def test_encodings_of_csv(spark, tmp_path, encoding, text):
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode(encoding))
    row = readers.read_csv(spark, str(path)).first()
    assert row["text"] == (None if "N/A" in text else "感謝") and row[0] == "1"


def test_bytes_of_no_encoding_are_an_error(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(b"id,text\n1,\xff\xff\xfe\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, str(path)).collect()


def test_quoted_line_breaks_need_the_option(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,text\n1,"a\nb"\n')
    assert readers.load_dataset(spark, str(path), multiline=True).collect() == [("1", "a\nb")]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000, 5001])
def test_quantiles_and_shares_equal_numpy(spark, n):
    import numpy as np

    values = np.random.default_rng(n).integers(0, max(2, n // 3), n).astype(float)
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = quantiles(frame, "v", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert np.allclose([row["a"], row["b"], row["c"]], np.quantile(values, [0.25, 0.5, 0.9]))
    share = top_share(frame, "v", 0.05).first()
    k = max(1, n // 20)
    assert share["k"] == k and share["top_sum"] == np.sort(values)[::-1][:k].sum() and share["total_sum"] == values.sum()


def test_volume_has_every_bin_however_far_apart(spark):
    rows = [("a", datetime.datetime(1999, 1, 1)), ("b", datetime.datetime(2024, 1, 1)), ("c", datetime.datetime(2024, 1, 1, 5, 59))]
    out = eda.volume_6h(spark.createDataFrame(rows, "id string, ts timestamp"))
    assert out.count() == (datetime.datetime(2024, 1, 1) - datetime.datetime(1999, 1, 1)).days * 4 + 1
    assert sorted(r["n_posts"] for r in out.where("n_posts > 0").collect()) == [1, 2]
    assert eda.volume_6h(spark.createDataFrame([], "id string, ts timestamp")).count() == 0


def test_relabelling_changes_one_topic_only(spark):
    frame = spark.createDataFrame([(0, "old0"), (1, "old1"), (1, "old1")], "topic_id int, analyst_label string")
    answers = spark.createDataFrame([(1, "new")], "topic_id int, label string")
    out = sorted((r["topic_id"], r["analyst_label"]) for r in topics.apply_labels(frame, answers).collect())
    assert out == [(0, "old0"), (1, "new"), (1, "new")]


def test_failing_extractors_are_counted(spark):
    from postlens.operators import narrative

    evidence = spark.createDataFrame([(0, "a", 1, ["x"]), (1, "b", 1, ["y"])], "topic_id int, analyst_label string, post_count bigint, samples array<string>")
    labels = spark.createDataFrame([(0, "T"), (1, "U")], "topic_id int, auto_label string")

    def extractor(label, keywords, samples):
        if label == "a":
            raise RuntimeError("no answer")
        return {"ACTOR": "someone", "NARRATIVE_STATEMENT": "told"}

    rows = {r["topic_id"]: r for r in narrative.narrative_table(evidence, labels, "en", extractor).collect()}
    assert rows[0]["source"] == "failed" and rows[1]["source"] == "llm" and rows[1]["ACTOR"] == "someone"


def test_parse_failures(spark):
    frame = spark.createDataFrame([("2024-01-01 00:00:00",), ("junk",), (None,)], "ts string")
    parsed = reshape.parse_ts_utc(frame.withColumnRenamed("ts", "ts"))
    assert [r["ts"] is None for r in parsed.collect()] == [False, True, True]
