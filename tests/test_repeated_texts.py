"""Posts that repeat a text: the work on words is done once a text, with the same counts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from postlens.operators import topics


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_terms_are_read_once_a_text_and_count_as_often_as_it_occurs(spark):
    rows = [(0, "red fish"), (0, "red fish"), (0, "red red fish"), (1, "red fish"), (None, "blue"), (1, None)]
    frame = spark.createDataFrame(rows, "topic_id int, tokens_lem_str string")
    terms = topics.corpus_terms(frame)
    assert sorted((r["topic_id"], r["term"], r["copies"]) for r in terms.where("topic_id IS NOT NULL").collect()) == [
        (0, "fish", 1), (0, "fish", 2), (0, "red", 1), (0, "red", 1), (0, "red", 2), (1, "fish", 1), (1, "red", 1),
    ]
    counts = {(r["topic_id"], r["term"]): r["tf"] for r in topics.topic_term_counts(terms).collect()}
    assert counts == {(0, "red"): 4, (0, "fish"): 3, (1, "red"): 1, (1, "fish"): 1, (None, "blue"): 1}
    by_post = {r["term"]: (r["df"], r["tf"]) for r in topics.vocab(frame, "post", 1).collect()}
    assert by_post == {"red": (4, 5), "fish": (4, 4), "blue": (1, 1)}


def test_prefixes_of_topics_are_not_summed_anew_for_every_term(spark):
    """A frame that ends with its partition costs the square of a topic's terms."""
    scored = spark.createDataFrame([(t, f"w{i}", 1.0 + i) for t in range(2) for i in range(4)], "topic_id int, term string, score double")
    found = topics.similar_topics(scored, 0.7)
    assert "unboundedfollowing" not in plan(found)
    assert [(r["topic_a"], r["topic_b"], round(r["cosine"], 9)) for r in found.collect()] == [(0, 1, 1.0)]


def small_tables(spark, folder) -> str:
    """Four texts, each the text of ten events."""
    texts = [(i, f"the words of text {i}", "en", f"src{i}", 10) for i in range(4)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    events = spark.range(40).select(
        F.col("id").alias("event_id"), F.lit(1.0).alias("value"), F.lit("click").alias("event_type"), F.current_timestamp().alias("ts")
    )
    events.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_a_stage_of_posts_writes_each_text_once(spark, tmp_path):
    from postlens.plans import bind

    staged = bind.topic_stage(spark, small_tables(spark, tmp_path))
    written = [f for f in staged.inputFiles() if "topic-texts" in f]
    assert staged.count() == 40 and spark.read.parquet(*written).count() == 4


def test_tokens_and_scores_are_made_before_posts_are_joined(spark, tmp_path):
    """The join copies rows, so what stands above it in the plan is done once a post."""
    from postlens.plans import queries_text as queries

    tables = small_tables(spark, tmp_path)
    for query in (queries.filter_tokens, queries.tokenize_zh, queries.tokenize_latin, queries.tier2_lexicon):
        above = plan(query(spark, tables)).split("join inner")[0]
        assert "regexp" not in above and "transform" not in above


def test_words_and_copies_of_texts_that_stand_for_many_posts(spark):
    """One row a text with its number of posts gives what the posts give, and no text is grouped by."""
    from postlens.operators import amplification

    rows = [(0, "red fish", 2), (0, "red red fish", 1), (1, "red fish", 3), (None, "blue", 1), (1, None, 2), (0, "red fish", 1)]
    texts = spark.createDataFrame(rows, "topic_id int, tokens_lem_str string, copies long").withColumn("text", F.col("tokens_lem_str"))
    posts = texts.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")
    assert "aggregate" not in plan(topics.corpus_terms(texts, copies="copies"))
    once, each = topics.ctfidf(texts, 1, copies="copies"), topics.ctfidf(posts, 1)
    assert sorted(map(str, once.collect())) == sorted(map(str, each.collect()))
    assert amplification.proxy_duplication(texts, "copies").collect() == amplification.proxy_duplication(posts).collect()


def test_texts_are_normalised_once_before_they_are_written(spark, tmp_path, monkeypatch):
    """A test of the length below the columns that it is made of normalises every text a second time."""
    from postlens.plans import bind

    written = []
    monkeypatch.setattr(bind, "stored", lambda df, name: written.append(plan(df)) or df)
    tables = small_tables(spark, tmp_path)
    posts, texts = bind.topic_stages(spark, tables)
    bind.corpus_texts(spark, tables)
    assert len(written) == 2 and not any("length(" in w for w in written)
    assert posts.count() == 40 and sorted(r["copies"] for r in texts.collect()) == [10] * 4


def test_samples_are_found_without_their_texts(spark):
    rows = [(t, f"p{i}", float(i % 3), f"text {i}") for t in (-1, 0, 1) for i in range(9)] + [(0, None, 9.0, "last")]
    frame = spark.createDataFrame(rows, "topic_id int, id string, engagement double, text string")
    found = topics.topic_samples(frame, 3)
    first = plan(found).split("leftsemi")[1]
    assert "windowgrouplimit" in first or "window" in first
    assert not any("text" in line for line in first.splitlines() if "window" in line)
    got = sorted((r["topic_id"], r["rank"], r["text"]) for r in found.collect())
    assert got == [(0, 1, "last"), (0, 2, "text 2"), (0, 3, "text 5"), (1, 1, "text 2"), (1, 2, "text 5"), (1, 3, "text 8")]


def test_topics_are_fitted_on_texts_and_posts_get_the_same_as_one_by_one(spark, monkeypatch):
    """40 texts of 400 posts: what is counted and written has a row a text, with the texts given apart or not."""
    from postlens.session import stored

    draw = random.Random(4)
    words = [[f"{'ab'[i % 3 == 0]}{draw.randrange(9)}" for _ in range(8 + i % 4)] for i in range(40)]
    texts = spark.createDataFrame([(i, w, " ".join(w)) for i, w in enumerate(words)], "text_id long, tokens array<string>, tokens_lem_str string")
    slim = spark.createDataFrame([(f"p{i}", i % 40, i) for i in range(400)], "id string, text_id long, extra long")
    whole = slim.join(texts, "text_id").select("id", "tokens", "tokens_lem_str", "extra")
    counted, written = [], []

    def scores(topics_, *args, **options):
        counted.append(topics_.count())
        return ctfidf(topics_, *args, **options)

    def kept(df, name):
        written.append((name, [c for c in df.columns if c.startswith("tokens")], table := stored(df, name)))
        return table

    ctfidf = topics.ctfidf
    monkeypatch.setattr(topics, "ctfidf", scores)
    monkeypatch.setattr(topics, "stored", kept)
    options = {"dims": 2, "radius": 0.4, "min_points": 3, "min_topic_size": 10}
    a = {(r["id"], r["topic_id"]) for r in topics.fit_topics(whole, **options).select("id", "topic_id").collect()}
    b = {(r["id"], r["topic_id"]) for r in topics.fit_topics(slim, texts=texts, **options).select("id", "topic_id").collect()}
    assert a == b and len(a) == 400 and len({t for _, t in a} - {-1}) >= 1
    assert len(counted) == 2 and max(counted) <= 40
    assert all(table.count() <= 40 for _, columns, table in written if columns)


def test_the_analysis_prepares_and_writes_texts_once_and_keeps_the_first_post_of_an_id(spark, monkeypatch):
    from postlens.plans import run
    from postlens.session import stored

    texts = [f"the {'river flood' if i % 3 else 'bread oven'} was {'good' if i % 4 else 'bad'} number {i % 7} in week {i}" for i in range(12)]
    rows = [(f"p{i}", texts[i % 12], "web", "ann" if i % 2 else "bot", float(i % 5)) for i in range(240)]
    # Copies of an id: only the text tells them apart, and the least counts; one is blank, one has no text, two no id.
    rows += [("p1", "a text before all others", "web", "ann", 1.0), ("q", " ", "web", "ann", 1.0), ("r", None, "web", "ann", 1.0)]
    rows += [(None, texts[0], "web", "ann", 1.0), (None, texts[0], "web", "ann", 1.0)]
    posts = spark.createDataFrame(rows, "id string, text string, platform string, author string, engagement double").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    written = []

    def kept(df, name, **options):
        table = stored(df, name, **options)
        written.append((name, df.columns, table.count()))
        return table

    for module in (run, topics):
        monkeypatch.setattr(module, "stored", kept)
    labelled, summary = run.label_stage(posts, "en", bot_labels=["bot"])
    assert labelled.columns[:6] == posts.columns and {"text_norm", "lang", "tokens", "tokens_lem_str", "token_count", "final_label"} <= set(labelled.columns)
    got = {r["id"]: r["text"] for r in labelled.where("id IS NOT NULL").collect()}
    assert got == {f"p{i}": texts[i % 12] for i in range(1, 240, 2)} | {"p1": "a text before all others"}
    assert labelled.where("id IS NULL").count() == 2
    assert summary.first().asDict() == {"organic_rows": 122, "quarantine_rows": 2, "bot_rows": 120, "starting_rows": 245, "organic_pct": 49.8}
    done = run.analyse_posts(posts.where("id IS NOT NULL"), "en", bot_labels=["bot"], dims=2, min_points=2)
    assert done.topics.count() == 120 and set(done.topics.columns) >= {*posts.columns, "tokens", "final_label", "topic_id", "analyst_label"}
    assert all(n <= 20 for _, columns, n in written if {"text", "tokens", "text_norm"} & set(columns))
    assert done.duplication.first()["n_valid"] == 120
