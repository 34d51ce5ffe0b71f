"""The pipeline as a whole, language detection, topics with outliers, the report's wording."""

import datetime

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from postlens.operators import brief, prepare, topics
from postlens.plans.run import analyse_posts, label_stage
from postlens.seeds import phrases

DAY = datetime.datetime(2024, 3, 1)
ENGLISH = ["This is great and helpful, thank you", "We love the wonderful support", "Terrible and awful service, so angry"]
CHINESE = ["這次非常感謝大家的幫忙", "這個政府失職，大家都很失望", "大家說平安就好，加油"]


def posts_of(spark, texts, times=1):
    rows = [
        (f"p{i}", text + f" n{chr(97 + i % 20)}", DAY + datetime.timedelta(hours=i), f"a{i % 3}", float(i), f"s{i % 2}")
        for i, text in enumerate(texts * times)
    ]
    return spark.createDataFrame(rows, "id string, text string, ts timestamp, author string, engagement double, platform string")


def test_automatic_language_labels_both_languages(spark):
    labelled, _ = label_stage(posts_of(spark, ENGLISH + CHINESE))
    rows = {r["text"]: (r["lang"], r["final_label"]) for r in labelled.collect()}
    langs = [lang for lang, _ in rows.values()]
    assert sorted(set(langs)) == ["en", "zh-TW"] and langs.count("en") == 3
    for text, (_, label) in rows.items():
        wanted = "POSITIVE" if text.split(" n")[0] in (ENGLISH[0], ENGLISH[1], CHINESE[0], CHINESE[2]) else "NEGATIVE"
        assert label.startswith(wanted), text


def test_detected_language_equals_trigram_counts(spark):
    rows = [("1", "aaa bbb aaa", "x"), ("2", "bbb bbb ccc", "y"), ("3", "zzz", "z"), ("4", "a", None), ("5", "感謝這些人", None), ("6", None, None)]
    posts = spark.createDataFrame(rows, "id string, text string, lang string")
    profiles = spark.createDataFrame([("x", "aaa"), ("y", "bbb"), ("z", "bbb")], "lang string, trigram string")
    got = {r["id"]: r["lang"] for r in prepare.detect_language(posts.drop("lang"), profiles).collect()}
    assert got == {"1": "x", "2": "y", "3": "auto", "4": "auto", "5": "zh-TW", "6": "auto"}


def located(spark, extra):
    rows = [(i, [0.1 * (i % 5) + 10 * (i % 2), 0.1 * (i % 7) + 10 * (i % 2)]) for i in range(200)] + extra
    return spark.createDataFrame(rows, "id bigint, coords array<double>")


@pytest.mark.parametrize("extra", [[], [(200, [1000.0, 1000.0])], [(200, [1e9, 0.0]), (201, [0.0, -1e9])]])
def test_a_post_far_out_does_not_join_topics(spark, extra):
    found = topics.density_topics(located(spark, extra), 2, min_topic_size=15)
    sizes = {r["topic_id"]: r["count"] for r in found.groupBy("topic_id").count().collect()}
    assert sizes.get(0, 0) >= 95 and sizes.get(1, 0) >= 95 and len([k for k in sizes if k >= 0]) == 2


def test_many_cells_are_no_error(spark):
    found = topics.density_topics(located(spark, []), 2, bins=2000, min_points=1, min_topic_size=1)
    assert found.count() == 200


def test_kmeans_sizes_and_distances(spark):
    frame = located(spark, []).withColumn("vector", array_to_vector("coords"))
    rows = topics.kmeans_topics(frame, 2, 3.0, 15).collect()
    assert sorted(r["topic_id"] for r in rows) == [0] * 100 + [1] * 100
    assert {r["topic_id"] for r in topics.kmeans_topics(frame, 2, 0.0001, 15).collect()} == {-1}


def test_reduction_is_orthogonal_and_keeps_most_variance(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    data = rng.normal(size=(300, 6)) * np.array([5, 3, 1, 0.1, 0.1, 0.1])
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], "id bigint, v array<double>")
    out = topics.reduce_dims(frame.withColumn("vector", array_to_vector("v")), 3)
    coords = np.array([r["coords"] for r in out.orderBy("id").collect()])
    spread = np.cov(coords.T)
    assert abs(spread - np.diag(np.diag(spread))).max() < 0.2
    assert np.trace(spread) > 0.98 * np.trace(np.cov(data.T))


def test_vocabulary_has_no_cap_by_default(spark):
    rows = [(t, " ".join(f"w{i}" for i in range(6000))) for t in (0, 1)]
    frame = spark.createDataFrame(rows, "topic_id int, tokens_lem_str string")
    assert topics.vocab(frame).count() == 6000 and topics.vocab(frame, max_terms=10).count() == 10
    assert topics.ctfidf(frame).count() == 12000


def test_alike_topics_are_merged_on_request(spark):
    texts = ["river flood water bridge road", "bread cake flour oven sugar"]
    frame = posts_of(spark, texts, 40).withColumn("tokens", F.split("text", " ")).withColumn("tokens_lem_str", F.col("text"))
    kept = topics.fit_topics(frame, dims=2, min_points=2, merge_at=None)
    merged = topics.fit_topics(frame, dims=2, min_points=2, merge_at=0.99)
    n = lambda df: df.where("topic_id >= 0").select("topic_id").distinct().count()
    assert 2 <= n(merged) <= n(kept)


def test_pipeline_gives_findings_in_both_languages(spark):
    for texts in (ENGLISH, CHINESE):
        done = analyse_posts(posts_of(spark, texts, 20), dims=2, min_points=2)
        found = done.findings.collect()
        assert found and all(r["limitations"] for r in found)
        assert not done.gate.first()["skipped"]


def test_too_few_posts_give_a_reason_and_all_other_results(spark):
    done = analyse_posts(posts_of(spark, ENGLISH))
    assert done.gate.first()["skipped"] and done.signals.count() >= 4
    assert done.topics.where("topic_id <> -1").isEmpty()


def test_missing_text_is_an_error(spark):
    with pytest.raises(ValueError):
        label_stage(posts_of(spark, ENGLISH).drop("text"))


def test_both_languages_have_the_same_phrases():
    assert phrases.ZH.keys() == phrases.EN.keys()
    for key in phrases.EN:
        count = lambda t: t.replace("%%", "").count("%")
        assert count(phrases.EN[key]) == count(phrases.ZH[key]), key


@pytest.mark.parametrize("language", ["zh-TW", "en"])
def test_report_has_six_sections_and_every_topic(spark, language):
    done = analyse_posts(posts_of(spark, ENGLISH, 20), "en", dims=2, min_points=2)
    matrix = spark.createDataFrame(
        [(f"topic number {i} with a long name of its own", 1000 + i, 10.0, 20.0, 30.0, 40.0, 0.0) for i in range(30)],
        "topic string, n bigint, POSITIVE double, NEGATIVE double, `NEGATIVE-DISTRESS` double, NEUTRAL double, UNCERTAIN double",
    )
    from postlens.operators import amplification as A

    lines = brief.brief_lines(
        done.topics, matrix, done.narratives, done.findings, done.engagement, A.proxy_author(done.topics), done.bursts,
        done.duplication, done.verdict, language,
    ).orderBy("section", "ord", "sub")
    text = "\n".join(r["line"] for r in lines.collect())
    for k in range(1, 7):
        assert f"## {phrases.phrase(language, f'section_{k}')}" in text
    assert text.count("with a long name of its own | 1,0") == 30


def test_limitations_follow_the_data(spark):
    posts = posts_of(spark, ENGLISH).withColumn("engagement", F.when(F.col("id") != "p0", F.col("engagement"))).drop("author")
    lines = [r["line"] for r in brief.limitations(posts).orderBy("ord").collect()]
    assert lines[0] == phrases.EN["gap"] % ("engagement", "33.3") and lines[1] == phrases.EN["no_author"] and len(lines) == 6
