"""Topics and narratives over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import narrative, neighbours, topics, vectors
from postlens.operators.topics import walsh_coords
from postlens.plans import bind as B
from postlens.plans.bind import half_even, pct
from postlens.plans.catalog import cte, query
from postlens.session import drop_stored, stored

DIMS, BINS, MIN_POINTS, MIN_SIZE = 3, 6, 5, 10
MERGE_AT = 0.85


@query("topic_corpus", "SELECT id, text_norm FROM prepared WHERE length(text_norm) >= 4")
def topic_corpus(spark, sf_dir):
    return topics.topic_corpus(B.prepared(spark, sf_dir)).select("id", "text_norm")


@query(
    "topic_corpus_summary",
    """SELECT count(*) FILTER (WHERE length(text_norm) >= 4) AS row_count,
        count(*) FILTER (WHERE length(text_norm) < 4) AS filtered_short_text FROM prepared""",
)
def topic_corpus_summary(spark, sf_dir):
    return topics.topic_corpus_summary(B.prepared(spark, sf_dir))


@query(
    "topic_gate",
    """SELECT n AS row_count, n < 30 AS skipped,
        CASE WHEN n < 30 THEN 'only ' || n || ' valid posts; need ≥30 for clustering' END AS reason
    FROM (SELECT count(*) AS n FROM prepared WHERE length(text_norm) >= 4)""",
)
def topic_gate(spark, sf_dir):
    return topics.topic_gate(topics.topic_corpus(B.prepared(spark, sf_dir)))


cte(
    "normal_texts",
    f"""SELECT doc_id AS id, {B.sql_latin_words("text_norm")} AS tokens FROM (
        SELECT doc_id, {B.sql_normalize("text")} AS text_norm FROM documents) WHERE length(text_norm) >= 4""",
    True,
)
cte("text_terms", "SELECT id, t AS term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS t FROM normal_texts) GROUP BY ALL", True)
cte(
    "raw_weights",
    """SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM normal_texts))::DOUBLE / (1 + df)) + 1) AS raw
    FROM text_terms JOIN (SELECT term, count(*) AS df FROM text_terms GROUP BY term) USING (term)""",
    True,
)


@query(
    "embed_posts",
    f"""SELECT id, term, {half_even("raw / len", 9)} AS weight FROM raw_weights
    JOIN (SELECT id, sqrt(sum(raw * raw)) AS len FROM raw_weights GROUP BY id) USING (id)""",
)
def embed_posts(spark, sf_dir):
    weights = vectors.sparse_vectors(B.corpus_texts(spark, sf_dir).select("doc_id", "tokens"), id_col="doc_id")
    return weights.withColumn("weight", F.rint(F.col("weight") * 1e9) / 1e9)


@query("reduce_sparse")
def reduce_sparse(spark, sf_dir):
    corpus = B.corpus_texts(spark, sf_dir).select("doc_id", "tokens")
    posts = corpus.count()
    found = vectors.sparse_vectors(corpus, id_col="doc_id", packed=True)
    drop_stored(corpus)
    reduced = vectors.reduce_sparse(found, DIMS, posts)
    return reduced.select("id", *[F.round(F.get("coords", F.lit(i)), 6).alias(f"c{i}") for i in range(DIMS)])


@query("reduce_dims")
def reduce_dims(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    embedded = B.table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("vector"))
    reduced = topics.reduce_dims(embedded, DIMS)
    return reduced.select("vec_id", *[F.round(F.get("coords", F.lit(i)), 6).alias(f"c{i}") for i in range(DIMS)])


def _located(spark, sf_dir):
    return B.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", walsh_coords(F.col("embedding"), DIMS).alias("coords")
    )


def _axis(j: int) -> str:
    return (
        "list_sum(list_transform(embedding, lambda x, i: CASE WHEN bit_count(((i - 1) & "
        f"{1 << j})::BIGINT) % 2 = 0 THEN x::DOUBLE ELSE -(x::DOUBLE) END))"
    )


@query(
    "walsh_coords",
    "SELECT vec_id, " + ", ".join(f"{half_even(_axis(j), 9)} AS c{j}" for j in range(DIMS)) + " FROM embeddings",
)
def walsh(spark, sf_dir):
    return _located(spark, sf_dir).select(
        "vec_id", *[(F.rint(F.get("coords", F.lit(j)) * 1e9) / 1e9).alias(f"c{j}") for j in range(DIMS)]
    )


def _slot(j: int) -> str:
    return f"greatest(least(CAST(floor((c{j} - low{j}) / ((high{j} - low{j}) / {BINS})) AS BIGINT), {BINS - 1}), 0)"


def _edge(j: int, share: float) -> str:
    """The value at rank ceil(share * n), which the sketch gives for tables of this size."""
    return f"list_sort(list(c{j}))[CAST(ceil({share} * count(*)) AS BIGINT)]"


cte("axes", "SELECT vec_id, " + ", ".join(f"{_axis(j)} AS c{j}" for j in range(DIMS)) + " FROM embeddings", True)
cte(
    "edges",
    "SELECT "
    + ", ".join(f"{_edge(j, topics.BOX[0])} AS low{j}, {_edge(j, topics.BOX[1])} AS high{j}" for j in range(DIMS))
    + " FROM axes",
    True,
)
cte("slots", "SELECT vec_id, " + ", ".join(f"{_slot(j)} AS s{j}" for j in range(DIMS)) + " FROM axes, edges", True)
cte(
    "dense_cells",
    f"""SELECT s0, s1, s2, s0 + {BINS} * s1 + {BINS * BINS} * s2 AS cell, count(*) AS n FROM slots
    GROUP BY s0, s1, s2 HAVING count(*) >= {MIN_POINTS}""",
    True,
)
cte(
    "reach",
    """SELECT cell AS a, cell AS b FROM dense_cells
    UNION SELECT r.a, q.cell FROM reach r JOIN dense_cells p ON p.cell = r.b
    JOIN dense_cells q ON abs(p.s0 - q.s0) + abs(p.s1 - q.s1) + abs(p.s2 - q.s2) = 1""",
)
cte("cell_groups", "SELECT b AS cell, min(a) AS component FROM reach GROUP BY b")
cte(
    "numbered_cells",
    f"""SELECT component, row_number() OVER (ORDER BY sum(n) DESC, component) - 1 AS topic_id
    FROM cell_groups JOIN dense_cells USING (cell) GROUP BY component HAVING sum(n) >= {MIN_SIZE}""",
)


@query(
    "density_topics",
    f"""SELECT vec_id, CAST(coalesce(topic_id, -1) AS INTEGER) AS topic_id FROM slots
    LEFT JOIN cell_groups ON cell_groups.cell = s0 + {BINS} * s1 + {BINS * BINS} * s2
    LEFT JOIN numbered_cells USING (component)""",
)
def density_topics(spark, sf_dir):
    found = topics.density_topics(_located(spark, sf_dir), DIMS, BINS, MIN_POINTS, MIN_SIZE)
    return found.select("vec_id", "topic_id")


@query("neighbour_topics")
def neighbour_topics(spark, sf_dir):
    found = neighbours.neighbour_topics(_located(spark, sf_dir), DIMS, 0.25, MIN_POINTS, MIN_SIZE)
    return found.select("vec_id", "topic_id")


@query("kmeans_topics")
def kmeans_topics(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    embedded = B.table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("vector"))
    return topics.kmeans_topics(embedded, 10, 1.0).select("vec_id", "topic_id")


@query("fit_topics")
def fit_topics(spark, sf_dir):
    texts = B.numbered_texts(spark, sf_dir, "source", "tokens_lem_str")
    corpus = B.with_events(spark, sf_dir, texts).select("id", "text_id")
    return topics.fit_topics(corpus, 3, min_points=5, min_topic_size=10, texts=texts).select("id", "topic_id")


# --- keywords -----------------------------------------------------------------

cte(
    "term_rows",
    f"""SELECT id, topic_id, unnest(regexp_extract_all(lower(tokens_lem_str), '[{B.SQL_WORD}]{{2,}}')) AS term
    FROM topic_posts""",
    True,
)
cte(
    "topic_vocab",
    """SELECT term, count(DISTINCT topic_id) AS df, count(*) AS tf FROM term_rows GROUP BY term
    HAVING count(DISTINCT topic_id) >= 2""",
    True,
)
cte("kept_terms", "SELECT topic_id, term, count(*) AS tf FROM term_rows SEMI JOIN topic_vocab USING (term) GROUP BY ALL", True)
cte(
    "topic_scores",
    """SELECT topic_id, k.term, k.tf, k.tf / words * ln(1.0::DOUBLE + (SELECT floor(avg(w)) FROM
        (SELECT sum(tf) AS w FROM kept_terms GROUP BY topic_id)) / v.tf) AS score
    FROM kept_terms k JOIN topic_vocab v ON v.term = k.term
    JOIN (SELECT topic_id, sum(tf)::DOUBLE AS words FROM kept_terms GROUP BY topic_id) USING (topic_id)""",
    True,
)
cte(
    "keyword_ranks",
    """SELECT topic_id, CAST(place AS INTEGER) AS rank, term, score FROM (SELECT *, row_number() OVER (
        PARTITION BY topic_id ORDER BY round(score, 12) DESC, term) AS place FROM topic_scores WHERE topic_id <> -1)
    WHERE place <= 10""",
    True,
)


@query("vocab", "SELECT * FROM topic_vocab")
def vocab(spark, sf_dir):
    return topics.vocab(B.topic_posts(spark, sf_dir))


@query(
    "vocab_by_post",
    """SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM term_rows GROUP BY term
    HAVING count(DISTINCT id) >= 2""",
)
def vocab_by_post(spark, sf_dir):
    return topics.vocab(B.topic_posts(spark, sf_dir), "post")


@query("ctfidf", f"SELECT CAST(topic_id AS INTEGER) AS topic_id, term, tf, {half_even('score', 9)} AS score FROM topic_scores")
def ctfidf(spark, sf_dir):
    scored = topics.ctfidf(B.topic_stages(spark, sf_dir)[1], copies="copies")
    return scored.withColumn("score", F.rint(F.col("score") * 1e9) / 1e9)


@query("top_keywords", "SELECT CAST(topic_id AS INTEGER) AS topic_id, rank, term FROM keyword_ranks")
def top_keywords(spark, sf_dir):
    scored = topics.ctfidf(B.topic_stages(spark, sf_dir)[1], copies="copies")
    return topics.top_keywords(scored).select("topic_id", "rank", "term")


# Sources as topics: 20 classes of mixed language, so that some of them are alike.
cte(
    "source_terms",
    f"""SELECT CAST(replace(platform, 'src', '') AS INTEGER) AS topic_id,
        unnest(regexp_extract_all(lower(tokens_lem_str), '[{B.SQL_WORD}]{{2,}}')) AS term FROM prepared""",
    True,
)
cte(
    "source_vocab",
    """SELECT term, count(*) AS uses FROM source_terms GROUP BY term HAVING count(DISTINCT topic_id) >= 2
   """,
    True,
)
cte("source_kept", "SELECT topic_id, term, count(*) AS tf FROM source_terms SEMI JOIN source_vocab USING (term) GROUP BY ALL", True)
cte(
    "source_scores",
    """SELECT topic_id, k.term, k.tf / words * ln(1.0::DOUBLE + (SELECT floor(avg(w)) FROM
        (SELECT sum(tf) AS w FROM source_kept GROUP BY topic_id)) / v.uses) AS score
    FROM source_kept k JOIN source_vocab v ON v.term = k.term
    JOIN (SELECT topic_id, sum(tf)::DOUBLE AS words FROM source_kept GROUP BY topic_id) USING (topic_id)""",
    True,
)
cte(
    "source_pairs",
    """SELECT topic_a, topic_b, dot / (na * nb) AS cosine FROM (
        SELECT a.topic_id AS topic_a, b.topic_id AS topic_b, sum(a.score * b.score) AS dot
        FROM source_scores a JOIN source_scores b ON a.term = b.term AND a.topic_id < b.topic_id GROUP BY ALL)
    JOIN (SELECT topic_id AS topic_a, sqrt(sum(score * score)) AS na FROM source_scores GROUP BY 1) USING (topic_a)
    JOIN (SELECT topic_id AS topic_b, sqrt(sum(score * score)) AS nb FROM source_scores GROUP BY 1) USING (topic_b)""",
    True,
)
cte(
    "reach_topics",
    f"""SELECT DISTINCT topic_id AS a, topic_id AS b FROM source_scores
    UNION SELECT r.a, CASE WHEN p.topic_a = r.b THEN p.topic_b ELSE p.topic_a END FROM reach_topics r
    JOIN source_pairs p ON (p.topic_a = r.b OR p.topic_b = r.b) AND p.cosine >= {MERGE_AT}""",
)


def _source_scores(spark, sf_dir):
    number = F.regexp_replace("platform", "src", "").cast("int")
    terms = B.prepared(spark, sf_dir).select(number.alias("topic_id"), "tokens_lem_str")
    return topics.ctfidf(terms)


@query(
    "similar_topics",
    f"SELECT topic_a, topic_b, {half_even('cosine', 6)} AS cosine FROM source_pairs WHERE cosine >= {MERGE_AT}",
)
def similar_topics(spark, sf_dir):
    pairs = topics.similar_topics(stored(_source_scores(spark, sf_dir), "topic-terms"), MERGE_AT)
    return pairs.withColumn("cosine", F.rint(F.col("cosine") * 1e6) / 1e6)


@query("merge_topics", "SELECT b AS topic_id, min(a) AS merged_id FROM reach_topics GROUP BY b")
def merge_topics(spark, sf_dir):
    return topics.merge_topics(_source_scores(spark, sf_dir), MERGE_AT)


@query("merge_to_count")
def merge_to_count(spark, sf_dir):
    return topics.merge_to_count(_source_scores(spark, sf_dir), 5)


# --- labels -------------------------------------------------------------------

cte(
    "drafts",
    """SELECT topic_id, CASE WHEN topic_id = -1 THEN '未歸類貼文（離群值）' ELSE 'T' || lpad(CAST(topic_id AS VARCHAR), 2, '0')
        || '：' || coalesce(head, '?') || '（待標記）' END AS auto_label
    FROM (SELECT DISTINCT topic_id FROM topic_posts) LEFT JOIN (
        SELECT topic_id, string_agg(term, '·' ORDER BY rank) AS head FROM keyword_ranks WHERE rank <= 3 GROUP BY topic_id)
    USING (topic_id)""",
    True,
)
cte("named_posts", "SELECT topic_posts.*, auto_label AS analyst_label FROM topic_posts JOIN drafts USING (topic_id)", True)
cte(
    "sample_ranks",
    """SELECT topic_id, CAST(place AS INTEGER) AS rank, id, platform, text, final_label, engagement FROM (
        SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY engagement DESC, id) AS place FROM topic_posts
        WHERE topic_id <> -1) WHERE place <= 8""",
    True,
)


def named_posts(spark, sf_dir):
    found, once = B.topic_stages(spark, sf_dir)
    drafts = stored(topics.auto_label(once, topics.top_keywords(topics.ctfidf(once, copies="copies"))), "draft-labels")
    return topics.with_labels(found, drafts), drafts


@query("auto_label", "SELECT CAST(topic_id AS INTEGER) AS topic_id, auto_label FROM drafts")
def auto_label(spark, sf_dir):
    return named_posts(spark, sf_dir)[1]


cte("size_by_topic", "SELECT CAST(topic_id AS INTEGER) AS topic_id, count(*) AS size FROM topic_posts GROUP BY 1")


@query("topic_sizes", "SELECT * FROM size_by_topic")
def topic_sizes(spark, sf_dir):
    return topics.topic_sizes(B.topic_posts(spark, sf_dir))


@query(
    "topic_summary",
    f"""SELECT CAST(sum(size) AS BIGINT) AS row_count, count(*) FILTER (WHERE topic_id <> -1) AS topic_count,
        {pct("coalesce(sum(size) FILTER (WHERE topic_id = -1), 0)", "sum(size)")} AS outlier_pct,
        {pct("coalesce(sum(size) FILTER (WHERE topic_id = -1), 0)", "sum(size)")} > 5.0 AS outlier_alarm FROM size_by_topic""",
)
def topic_summary(spark, sf_dir):
    return topics.topic_summary(B.topic_posts(spark, sf_dir), 5.0)


@query(
    "topic_samples",
    """SELECT CAST(topic_id AS INTEGER) AS topic_id, rank, id, platform, left(text, 120) AS text, final_label, engagement
    FROM sample_ranks""",
)
def topic_samples(spark, sf_dir):
    return topics.topic_samples(B.topic_stage(spark, sf_dir))


@query(
    "apply_labels",
    """SELECT id, CASE topic_id WHEN 1 THEN 'French posts' ELSE analyst_label END AS analyst_label FROM named_posts""",
)
def apply_labels(spark, sf_dir):
    named, _ = named_posts(spark, sf_dir)
    answers = named.where(F.col("topic_id") == 1).select("topic_id", F.lit("French posts").alias("label")).distinct()
    return topics.apply_labels(named, answers).select("id", "analyst_label")


# --- narratives ---------------------------------------------------------------

cte(
    "evidence_rows",
    """SELECT topic_id, auto_label AS analyst_label, post_count, samples FROM (SELECT topic_id, count(*) AS post_count
        FROM topic_posts WHERE topic_id <> -1 GROUP BY topic_id) JOIN drafts USING (topic_id) JOIN (
        SELECT topic_id, string_agg(text, '|' ORDER BY rank) AS samples FROM sample_ranks GROUP BY topic_id) USING (topic_id)""",
    True,
)
cte(
    "stories",
    """SELECT topic_id, analyst_label, post_count, 'left to the analyst' AS ACTOR,
        'Posts on ''' || analyst_label || ''' often mention ''' || split_part(split_part(analyst_label, '：', 2), '（', 1) ||
        '''; an analyst has to read samples to say who wants what.' AS NARRATIVE_STATEMENT,
        'template' AS source FROM evidence_rows""",
    True,
)


def stories(spark, sf_dir):
    named, drafts = named_posts(spark, sf_dir)
    return narrative.narrative_table(narrative.narrative_evidence(named, drafts), drafts, "en")


@query("narrative_evidence", "SELECT CAST(topic_id AS INTEGER) AS topic_id, analyst_label, post_count, samples FROM evidence_rows")
def narrative_evidence(spark, sf_dir):
    named, drafts = named_posts(spark, sf_dir)
    return narrative.narrative_evidence(named, drafts).withColumn("samples", F.array_join("samples", "|"))


@query(
    "keywords_from_label",
    """SELECT CAST(topic_id AS INTEGER) AS topic_id, CASE WHEN topic_id = -1 THEN ''
        ELSE replace(split_part(split_part(auto_label, '：', 2), '（', 1), '·', '|') END AS keywords FROM drafts""",
)
def keywords_from_label(spark, sf_dir):
    _, drafts = named_posts(spark, sf_dir)
    words = narrative.keywords_from_label(F.col("auto_label"))
    return drafts.select("topic_id", F.array_join(words, "|").alias("keywords"))


@query(
    "narrative_table",
    """SELECT CAST(topic_id AS INTEGER) AS topic_id, analyst_label, post_count, ACTOR, ACTOR AS "ACTION", ACTOR AS VICTIM,
        ACTOR AS BLAME, ACTOR AS MORAL, ACTOR AS DESIRED, NARRATIVE_STATEMENT, source FROM stories""",
)
def narrative_table(spark, sf_dir):
    return stories(spark, sf_dir).drop("samples", "keywords")


@query("narrative_sources", "SELECT source, count(*) AS n FROM stories GROUP BY source")
def narrative_sources(spark, sf_dir):
    return narrative.narrative_sources(stories(spark, sf_dir))
