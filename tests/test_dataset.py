"""A raw file to its report; answers; languages; segmentation."""

import csv
import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from postlens.functions.segment import Trie
from postlens.functions.text import tokenize_dictionary
from postlens.operators import prepare, review
from postlens.plans.dataset import STAGES, analyse_file
from postlens.sources import sinks


@pytest.fixture(scope="module")
def posts_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw") / "posts.csv"
    rng = random.Random(3)
    themes = ["storm flood river water rescue rain street", "music concert band stage guitar singer crowd"]
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f)
        out.writerow(["post_id", "post_text", "created_at", "likes", "platform"])
        for i in range(80):
            words = themes[i % 2].split()
            rng.shuffle(words)
            text = f"The {' '.join(words[:6])} and the {words[6]} of this week are with us,\nnumber {i}"
            out.writerow([f"p{i}", text, f"2024-03-{1 + i % 20:02d} 10:00:00", str(i * 3), ["forum", "board"][i % 3 == 0]])
    return str(path)


def answer(spark, key, response, approved=True):
    return spark.createDataFrame([(key, response, approved, dt.datetime(2024, 1, 1))],
                                 "question_id string, response string, approved boolean, timestamp timestamp")


def test_file_to_report(spark, posts_file):
    labels = answer(spark, "topic-label-run", '{"labels": {"0": "My own name"}}')
    done = analyse_file(spark, posts_file, answers=labels, language="en", dims=2, radius=0.5, min_points=3, merge_at=None)
    assert (done.roles.id_col, done.roles.text_col, done.roles.timestamp_col) == ("post_id", "post_text", "created_at")
    log = spark.read.parquet(done.audit_path).collect()
    assert sorted(r["stage"] for r in log) == sorted(STAGES) and len(log) == 11
    rows = {r["stage"]: r["affected_rows"] for r in log}
    assert rows["ingest"] == rows["reshape"] == rows["sentiment"] == 80
    assert all(r["artifact_hash"].startswith(f"{r['affected_rows']}:") for r in log)
    assert {r["question_id"] for r in done.queue().collect()} >= {"schema-run", "topic-label-run"}
    topics = done.analysis.topics.select("topic_id", "analyst_label").distinct().collect()
    named = {r["topic_id"]: r["analyst_label"] for r in topics}
    assert len([t for t in named if t >= 0]) >= 2 and named[0] == "My own name" and named[1] != "My own name"
    lines = [r["line"] for r in done.lines.orderBy("section", "ord", "sub").collect()]
    assert sum(line.startswith("## ") for line in lines) == 6 and any("My own name" in line for line in lines)
    assert sinks.audit_tail(spark.read.parquet(done.audit_path), 3).count() == 3


def test_schema_answers_take_effect(spark, posts_file):
    chosen = answer(spark, "schema-run", '{"schema": {"engagement_col": null, "author_col": "platform", "platform_col": ""}}')
    row = review.schema_answer(chosen, ["engagement_col", "author_col"]).first()
    assert (row["engagement_col"], row["author_col"]) == (None, "platform")
    plain = answer(spark, "schema-run", '{"text_col": "likes"}')
    done = review.schema_answer(plain, ["text_col", "id_col"]).first()
    assert (done["text_col"], done["id_col"]) == ("likes", None)
    with pytest.raises(ValueError, match="rejected"):
        analyse_file(spark, posts_file, answers=answer(spark, "schema-run", None, False))


def test_gate_stops_a_run(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("id,text,ts\n" + "".join(f"{i},some longer words of post {i},not a date\n" for i in range(40)))
    from postlens.schema import DatasetRoles

    with pytest.raises(Exception, match="failed to parse"):
        analyse_file(spark, str(path), roles=DatasetRoles("id", "text", "en", timestamp_col="ts"))


LANGUAGES = {
    "en": ["The train was late and we have to wait for it", "They would like to know what this is"],
    "de": ["Das war nicht gut, und der Zug ist auch noch zu spät", "Wir sind mit dem Auto in die Stadt gefahren"],
    "fr": ["Le train est en retard et nous ne sommes pas contents", "Elle est dans la ville avec des amis"],
    "nl": ["Het was niet goed, maar wij zijn ook naar de stad gegaan", "Ik heb een boek van hem, maar het is niet nieuw"],
    "es": ["El tren llegó tarde y no hay más asientos para los niños", "Todo está muy bien, pero su casa es pequeña"],
    "auto": ["xyzzy plugh", "qwerty asdf was"],
}


def test_language_by_words(spark):
    rows = [(tag, t) for tag, texts in LANGUAGES.items() for t in texts]
    df = spark.createDataFrame(rows, "want string, text string")
    got = df.select("want", prepare.language_by_words(F.col("text")).alias("lang")).collect()
    assert [r["lang"] for r in got] == [r["want"] for r in got]


def all_paths(run):
    for cuts in itertools.product((False, True), repeat=max(len(run) - 1, 0)):
        at, out = 0, []
        for i, cut in enumerate([*cuts, True]):
            if cut:
                out.append(run[at : i + 1])
                at = i + 1
        yield out


def test_best_path_equals_all_paths():
    words = {"颱風": 50, "颱": 3, "風": 20, "風來": 2, "來": 30, "來了": 25, "了": 60, "台灣": 40, "加油": 30, "灣加": 1, "南京": 8,
             "南京市": 10, "市長": 9, "長江": 9, "長江大橋": 6, "大橋": 7, "江大橋": 1, "市": 5}
    trie, total = Trie(words), sum(words.values())

    def weight(path):
        found = [words.get(w) for w in path]
        if any(f is None and len(w) > 1 for w, f in zip(path, found)):
            return -math.inf
        return sum(math.log((f or 1) / total) for f in found)

    rng = random.Random(1)
    runs = ["南京市長江大橋", "颱風來了", "台灣加油"] + ["".join(rng.choice("颱風來了台灣加油南京市長江大橋?好") for _ in range(rng.randint(1, 10))) for _ in range(60)]
    for run in runs:
        got = trie.best(run)
        assert "".join(got) == run
        assert math.isclose(weight(got), max(weight(p) for p in all_paths(run)), rel_tol=1e-12)
    assert trie.best("南京市長江大橋") == ["南京市", "長江大橋"]


def test_segmentation_of_posts(spark):
    words = {"颱風": 50, "來了": 25, "台灣": 40, "加油": 30}
    df = spark.createDataFrame([(1, "颱風來了 iPhone15台灣加油"), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: r["t"] for r in df.select("id", tokenize_dictionary(F.col("text"), words).alias("t")).collect()}
    assert got == {1: ["颱風", "來了", " ", "iPhone15", "台灣", "加油"], 2: None, 3: []}
    greedy = df.where("id = 1").select(tokenize_dictionary(F.col("text"), tuple(words)).alias("t")).first()["t"]
    assert greedy == got[1]
