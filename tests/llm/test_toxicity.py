import random

import pytest

from postlens.llm import toxicity as tox


def test_folding_meets_disguises():
    plain = tox.folded_words("idiot")
    for other in ("IDIOT", "1d1ot", "ld!ot", "іdіоt", "ìdïöt", "idiot!", "(idiot),"):
        assert tox.folded_words(other) == plain, other
    assert tox.folded_words("12 34 !! ...") == []


def matched(text, lexicon):
    return tox.hits(lexicon.matcher(), tox.folded_words(text))


def test_words_stems_and_exceptions():
    lexicon = tox.Lexicon({"ciown": 2.0, "trash": 1.0}, {"vequ": 3.0}, ("trash can",))
    assert matched("a clown and a Cl0wn", lexicon) == [2.0, 2.0]
    assert matched("clowns clowning", lexicon) == []
    assert matched("vequoir avequ", lexicon) == [3.0]
    assert matched("the trash can, trash", lexicon) == [1.0]
    assert matched("", lexicon) == []


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        text = [rng.choice(words) for _ in range(40)]
        if toxic:
            text[7] = rng.choice(["Zorgle", "z0rgle", "brupni" + rng.choice(words)])
        docs.append((i, " ".join(text), "en"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, score string"), spark.createDataFrame(
        labels, "doc_id bigint, quality int, toxic int"
    )


def test_learns_words_and_stems_and_scores_held_out_rows(spark, tables):
    docs, labels = tables
    model = tox.train(docs, labels)
    assert "zorgie" in model.lexicon.words and any("brupni".startswith(s) for s in model.lexicon.stems)
    rows = tox.score(docs, model).withColumn("held_out", tox.held_out()).where("held_out").collect()
    assert len(rows) > 100 and all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in rows)
    assert tox.drop_toxic(docs, labels).where("doc_id % 3 = 0").count() == 0
    assert tox.drop_toxic(docs, labels).columns == docs.columns


def test_labels_of_the_held_out_fold_change_nothing(tables):
    docs, labels = tables
    turned = labels.selectExpr("doc_id", "quality", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    assert tox.train(docs, labels) == tox.train(docs, turned)


def test_copies_are_one_piece_of_evidence(spark):
    copy = " ".join(f"only{i}" for i in range(60))
    docs = [(i, copy + f" end{i}") for i in range(100)] + [(100 + i, f"clean words number {i} here and more") for i in range(100)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 100)) for i in range(200)], "doc_id bigint, quality int, toxic int")
    assert not tox.train(frame, labels).lexicon.words


def test_nulls_and_empty_tables(spark, tables):
    docs, labels = tables
    model = tox.train(docs, labels.limit(0))
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id bigint, text string")
    rows = tox.score(odd, model).withColumn("held_out", tox.held_out()).collect()
    assert len(rows) == 3 and all(r["predicted"] == 0 and r["score"] < 1e-9 and r["held_out"] is not None for r in rows)
    assert tox.score(docs.limit(0), model).count() == 0


def test_scores_do_not_shift_with_the_bounds(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(2400):
        toxic = i % 12 == 0
        text = [rng.choice(words) for _ in range(40)]
        if rng.random() < (0.8 if toxic else 0.06):
            text[7] = "zorgle"
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").cache()
    given = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    free = tox.train(frame, given)
    monkeypatch.setattr(tox, "MAX_CLEAN", 150)
    capped = tox.train(frame, given)
    for weights in ([], [sorted(free.lexicon.words.values())[-1]]):
        assert abs(free.score(weights, 40) - capped.score(weights, 40)) < 0.15


def naive_hits(words, lexicon):
    """Every term at every word, every phrase at every place."""
    covered = set()
    for phrase in lexicon.exceptions:
        parts = tox.folded_words(phrase)
        for at in range(len(words) - len(parts) + 1):
            if words[at : at + len(parts)] == parts:
                covered.update(range(at, at + len(parts)))
    out = []
    for at, word in enumerate(words):
        weights = [w for term, w in lexicon.words.items() if word == term]
        weights += [w for stem, w in lexicon.stems.items() if word.startswith(stem)]
        if weights and at not in covered:
            out.append(max(weights))
    return out


def test_matcher_equals_every_term_at_every_word():
    rng = random.Random(21)
    pool = ["".join(rng.choice("abio") for _ in range(rng.randrange(1, 7))) for _ in range(120)]
    for _ in range(150):
        words = {rng.choice(pool): rng.choice([0.5, 1.0, 2.0]) for _ in range(rng.randrange(12))}
        stems = {w: rng.choice([0.25, 1.5, 3.0]) for w in rng.sample(pool, 8) if len(w) >= 3}
        phrases = tuple(" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 4))) for _ in range(6))
        lexicon = tox.Lexicon(words, stems, phrases)
        # Phrases stand in the text too, some cut short, some one after another.
        text = [rng.choice([*pool, *phrases, *(p.split()[0] for p in phrases)]) for _ in range(80)]
        given = tox.folded_words(" ".join(text))
        assert tox.hits(lexicon.matcher(), given) == naive_hits(given, lexicon)


def test_very_long_texts_and_clashing_columns(spark, tables):
    docs, labels = tables
    model = tox.train(docs, labels)
    long = "plain words " * 400_000 + "zorgle"
    rows = [(1, long, 0.7, 5, "x"), (2, "zorgle here", 0.1, 5, "y")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, score double, n_words int, predicted string")
    got = {r["doc_id"]: r for r in tox.score(frame, model).collect()}
    assert got[1]["n_words"] == 800_001 and got[1]["n_hits"] == 1 and got[2]["predicted"] == 1
    assert got[1]["score"] < got[2]["score"]
