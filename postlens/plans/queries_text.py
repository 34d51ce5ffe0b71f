"""Text preparation and sentiment over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.functions.numbers import let
from postlens.operators import prepare, sentiment
from postlens.plans import bind as B
from postlens.plans.bind import pct
from postlens.plans.catalog import cte, query
from postlens.session import stored

ZH_TERMS = ("tion", "the", "th", "eau", "eaux", "und")


def _chats(spark, sf_dir):
    """Chat turns; the users' turns are marked as re-shared, as in forwarded posts."""
    chats = B.table(spark, sf_dir, "conversations")
    shared = F.when(F.col("role") == "user", F.concat(F.lit("RT: "), "text")).otherwise(F.col("text"))
    return chats.select("conv_id", "turn", shared.alias("text"))


cte("chats", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'RT: ' || text ELSE text END AS text FROM conversations")


def _pages(spark, sf_dir):
    """Pages as posts that quote their address and mention their host."""
    host = F.regexp_replace(F.regexp_extract("url", "://([^/]+)", 1), "\\.", "_")
    return B.table(spark, sf_dir, "pages").select(
        "page_id", F.concat_ws(" ", F.concat(F.lit("@"), host), "url", "html").alias("text")
    )


cte(
    "page_posts",
    """SELECT page_id, '@' || replace(regexp_extract(url, '://([^/]+)', 1), '.', '_') || ' ' || url || ' ' || html
    AS text FROM pages""",
)


@query("strip_rt_prefix", f"SELECT conv_id, turn, {B.sql_rt('text')} AS text FROM chats")
def strip_rt_prefix(spark, sf_dir):
    return _chats(spark, sf_dir).withColumn("text", T.strip_rt_prefix(F.col("text")))


@query("strip_urls", f"SELECT page_id, {B.sql_urls('text')} AS text FROM page_posts")
def strip_urls(spark, sf_dir):
    return _pages(spark, sf_dir).withColumn("text", T.strip_urls(F.col("text")))


@query("strip_mentions", f"SELECT page_id, {B.sql_mentions('text')} AS text FROM page_posts")
def strip_mentions(spark, sf_dir):
    return _pages(spark, sf_dir).withColumn("text", T.strip_mentions(F.col("text")))


@query("strip_hash_symbol", f"SELECT page_id, {B.sql_hash('text')} AS text FROM page_posts")
def strip_hash_symbol(spark, sf_dir):
    return _pages(spark, sf_dir).withColumn("text", T.strip_hash_symbol(F.col("text")))


@query("cap_punct", f"SELECT doc_id, {B.sql_cap('text')} AS text FROM documents")
def cap_punct(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", T.cap_punctuation(F.col("text")).alias("text"))


@query("collapse_ws", f"SELECT doc_id, {B.sql_space('text')} AS text FROM documents")
def collapse_ws(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", T.collapse_space(F.col("text")).alias("text"))


@query("normalize_text", f"SELECT page_id, {B.sql_normalize('text')} AS text_norm FROM page_posts")
def normalize_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", T.normalize(F.col("text")).alias("text_norm"))


@query("assign_language", "SELECT id, 'zh-TW' AS lang FROM posts")
def assign_language(spark, sf_dir):
    return prepare.assign_language(B.posts(spark, sf_dir), "zh-TW", "text").select("id", "lang")


@query(
    "detect_script",
    f"""SELECT id, CASE WHEN length(regexp_replace(text, '^[{B.SQL_SPACE}]+|[{B.SQL_SPACE}]+$', '', 'g')) < 3 THEN 'auto'
        WHEN regexp_matches(text, '[一-鿿]') THEN
            CASE WHEN regexp_matches(text, '[颱這個們麼說發點時間實國灣為來]') THEN 'zh-TW' ELSE 'zh' END
        ELSE 'auto' END AS lang FROM posts""",
)
def detect_script(spark, sf_dir):
    return prepare.assign_language(B.posts(spark, sf_dir), "auto", "text").select("id", "lang")


cte("uses_of", "SELECT event_id % (SELECT count(*) FROM documents) AS doc_id, count(*) AS uses FROM events GROUP BY 1", True)
cte(
    "grams",
    """SELECT doc_id, lang, trigram, count(*) AS n FROM (SELECT doc_id, lang,
        unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS trigram
        FROM (SELECT doc_id, lang, string_split(lower(text), '') AS c FROM documents)) GROUP BY ALL""",
    True,
)
cte(
    "gram_counts",
    """SELECT lang, trigram, CAST(sum(n * uses) AS BIGINT) AS n FROM grams JOIN uses_of USING (doc_id)
    WHERE lang IS NOT NULL GROUP BY lang, trigram""",
    True,
)
cte(
    "gram_profiles",
    """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, trigram) AS INTEGER) AS rank
        FROM gram_counts) WHERE rank <= 300""",
    True,
)


@query("language_profiles", "SELECT lang, trigram, n, rank FROM gram_profiles")
def language_profiles(spark, sf_dir):
    return _profiles(spark, sf_dir)


def _profiles(spark, sf_dir):
    """Profiles of the posts; each text's triples are made once and count as often as the text is posted."""
    events = B.table(spark, sf_dir, "events")
    n = B.table(spark, sf_dir, "documents").count()
    uses = events.groupBy(F.pmod("event_id", F.lit(n)).alias("doc_id")).agg(F.count(F.lit(1)).alias("uses"))
    return prepare.language_profiles(B.texts(spark, sf_dir).join(uses, "doc_id"), weight=F.col("uses"))


@query(
    "detect_latin",
    """SELECT CAST(e.event_id AS VARCHAR) AS id, coalesce(tag, 'auto') AS lang
    FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents) LEFT JOIN (
        SELECT doc_id, arg_min(tag, struct_pack(hits := -hits, tag := tag)) AS tag FROM (
            SELECT g.doc_id, p.lang AS tag, sum(g.n) AS hits FROM grams g JOIN gram_profiles p ON g.trigram = p.trigram
            GROUP BY ALL) GROUP BY doc_id) best ON best.doc_id = d.doc_id""",
)
def detect_latin(spark, sf_dir):
    profiles = stored(_profiles(spark, sf_dir).select("lang", "trigram"), "language-profiles")
    texts = B.texts(spark, sf_dir).drop("lang")
    return B.with_events(spark, sf_dir, prepare.detect_language(texts, profiles, id_col="doc_id")).select("id", "lang")


@query(
    "tokenize_latin",
    "SELECT id, array_to_string(regexp_extract_all(lower(text), '[a-z'']+'), ' ') AS tokens FROM posts",
)
def tokenize_latin(spark, sf_dir):
    return _by_text(spark, sf_dir, F.array_join(T.tokenize_latin(F.col("text")), " "))


def _by_text(spark, sf_dir, tokens):
    """id, tokens of every post; the tokens are made once a text."""
    texts = B.texts(spark, sf_dir).select("doc_id", "source", tokens.alias("tokens"))
    return B.with_events(spark, sf_dir, texts).select("id", "tokens")


cte(
    "dictionary_tokens",
    "SELECT id, regexp_extract_all(text, '(?s)(?:eaux|tion|eau|the|und|th)|[A-Za-z0-9]+|.') AS tokens FROM posts",
)


@query("tokenize_zh", "SELECT id, array_to_string(tokens, '|') AS tokens FROM dictionary_tokens")
def tokenize_zh(spark, sf_dir):
    # The documents hold no Chinese, so frequent letter groups play the dictionary.
    return _by_text(spark, sf_dir, F.array_join(T.tokenize_dictionary(F.col("text"), ZH_TERMS), "|"))


@query(
    "filter_tokens",
    f"""SELECT id, array_to_string(list_filter(list_transform(tokens,
            lambda t: regexp_replace(t, '^[^{B.SQL_WORD}]+|[^{B.SQL_WORD}]+$', '', 'g')),
        lambda t: t NOT IN ('', '_', 'the', 'th') AND NOT regexp_matches(t, '^\\p{{Nd}}+$')), ' ') AS tokens
    FROM dictionary_tokens""",
)
def filter_tokens(spark, sf_dir):
    tokens = T.filter_tokens(T.tokenize_dictionary(F.col("text"), ZH_TERMS), ("the", "th"))
    return _by_text(spark, sf_dir, F.array_join(tokens, " "))


@query("token_columns", "SELECT id, tokens_lem_str, token_count FROM prepared")
def token_columns(spark, sf_dir):
    return B.prepared(spark, sf_dir).select("id", "tokens_lem_str", "token_count")


@query(
    "preprocess_summary",
    """SELECT count(*) AS row_count, count(*) FILTER (WHERE text_norm = '') AS empty_after_norm,
        count(*) FILTER (WHERE token_count < 3) AS very_short_lt3_tokens,
        CAST(floor(quantile_cont(token_count, 0.5)) AS INTEGER) AS median_token_count FROM prepared""",
)
def preprocess_summary(spark, sf_dir):
    return prepare.preprocess_summary(B.prepared(spark, sf_dir))


@query(
    "language_distribution",
    f"""SELECT lang, count(*) AS n, {pct("count(*)", "(SELECT count(*) FROM posts)")} AS pct FROM posts GROUP BY lang""",
)
def language_distribution(spark, sf_dir):
    return prepare.language_distribution(B.posts(spark, sf_dir))


# --- sentiment ----------------------------------------------------------------


@query("tier1_rules", "SELECT id, t1_label, t1_conf FROM tiers")
def tier1_rules(spark, sf_dir):
    return B.labelled(spark, sf_dir).select("id", "t1_label", "t1_conf")


def _lexicon_rows() -> str:
    rows = []
    for lang, lexicon in B.LEXICONS.items():
        for kind in ("positive", "negative"):
            rows += [f"('{lang}', '{kind}', '{w}', {n})" for w, n in getattr(lexicon, kind).items()]
        rows += [f"('{lang}', 'negator', '{w}', 0)" for w in lexicon.negators]
    return ", ".join(rows)


@query(
    "lexicon_table",
    f"""SELECT l.lang, kind, term, weight, count(w.word) AS uses
    FROM (VALUES {_lexicon_rows()}) l(lang, kind, term, weight)
    LEFT JOIN (SELECT lang, unnest(tokens) AS word FROM prepared) w ON w.lang = l.lang AND w.word = l.term
    GROUP BY l.lang, kind, term, weight""",
)
def lexicon_table(spark, sf_dir):
    words = (
        B.prepared(spark, sf_dir)
        .select("lang", F.explode("tokens").alias("term"))
        .groupBy("lang", "term")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    lexicon = sentiment.lexicon_table(spark, B.LEXICONS)
    return lexicon.join(words, ["lang", "term"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


@query("tier2_lexicon", "SELECT id, t2_label, t2_conf, CAST(score AS INTEGER) AS score FROM tiers")
def tier2_lexicon(spark, sf_dir):
    def tier2(post):
        return sentiment.tier2_from_score(sentiment.score_by_language(post["tokens"], post["lang"], B.LEXICONS))

    scored = B.prepared_texts(spark, sf_dir).select("doc_id", "source", let(F.struct("tokens", "lang"), tier2).alias("t2"))
    return B.with_events(spark, sf_dir, scored).select(
        "id", F.col("t2.label").alias("t2_label"), F.col("t2.conf").alias("t2_conf"), F.col("t2.score").alias("score")
    )


@query("combine_tiers", "SELECT id, final_label, sentiment_agreed FROM merged")
def combine_tiers(spark, sf_dir):
    return B.labelled(spark, sf_dir).select("id", "final_label", "sentiment_agreed")


@query(
    "label_posts", "SELECT id, t1_label, t1_conf, t2_label, t2_conf, final_label, sentiment_agreed FROM merged"
)
def label_posts(spark, sf_dir):
    return B.labelled(spark, sf_dir).select(
        "id", "t1_label", "t1_conf", "t2_label", "t2_conf", "final_label", "sentiment_agreed"
    )


cte(
    "sentiment_counts",
    f"""SELECT count(*) AS row_count,
        {", ".join(f"count(*) FILTER (WHERE final_label = '{x}') AS n_{x.lower().replace('-', '_')}"
                   for x in ("POSITIVE", "NEGATIVE", "NEUTRAL", "NEGATIVE-DISTRESS", "UNCERTAIN"))},
        {pct("count(*) FILTER (WHERE NOT sentiment_agreed)", "greatest(count(*), 1)")} AS disagreement_pct,
        {pct("count(*) FILTER (WHERE final_label = 'UNCERTAIN')", "greatest(count(*), 1)")} AS uncertain_pct FROM merged""",
)


@query("sentiment_summary", "SELECT * FROM sentiment_counts")
def sentiment_summary(spark, sf_dir):
    return sentiment.sentiment_summary(B.labelled(spark, sf_dir))


@query(
    "calibration_sample",
    """SELECT id, left(text, 200) AS text, t1_label, t1_conf, t2_label, t2_conf, final_label, engagement FROM merged
    WHERE NOT sentiment_agreed AND (SELECT disagreement_pct FROM sentiment_counts) > 15
    ORDER BY engagement DESC, id LIMIT 10""",
)
def calibration_sample(spark, sf_dir):
    return sentiment.calibration_sample(B.labelled(spark, sf_dir))


# Three rules that occur in the prose, one per kind of flip.
DOMAIN_PATTERNS = {
    "en": [("(?U)\\bthe (was|that)\\b", "positive_to_negative", 0.65), ("(?U)\\bfor the\\b", "negative_to_positive", 0.6)],
    "fr": [("(?U)\\bla le\\b", "ambiguous", 0.5)],
}


@query(
    "domain_patterns",
    f"""SELECT id, CASE WHEN lang = 'en' AND regexp_matches(text_norm, '(^|[^{B.SQL_WORD}])the (was|that)($|[^{B.SQL_WORD}])') THEN 'NEGATIVE'
        WHEN lang = 'en' AND regexp_matches(text_norm, '(^|[^{B.SQL_WORD}])for the($|[^{B.SQL_WORD}])') THEN 'POSITIVE'
        WHEN lang = 'fr' AND regexp_matches(text_norm, '(^|[^{B.SQL_WORD}])la le($|[^{B.SQL_WORD}])') THEN 'UNCERTAIN' ELSE t1_label END AS t1_label,
        CASE WHEN lang = 'en' AND regexp_matches(text_norm, '(^|[^{B.SQL_WORD}])the (was|that)($|[^{B.SQL_WORD}])') THEN 0.65::DOUBLE
        WHEN lang = 'en' AND regexp_matches(text_norm, '(^|[^{B.SQL_WORD}])for the($|[^{B.SQL_WORD}])') THEN 0.6::DOUBLE
        WHEN lang = 'fr' AND regexp_matches(text_norm, '(^|[^{B.SQL_WORD}])la le($|[^{B.SQL_WORD}])') THEN 0.5::DOUBLE ELSE t1_conf END AS t1_conf FROM tiers""",
)
def domain_patterns(spark, sf_dir):
    labelled = sentiment.label_posts(B.prepared_texts(spark, sf_dir), B.LEXICONS, DOMAIN_PATTERNS)
    return B.with_events(spark, sf_dir, labelled).select("id", "t1_label", "t1_conf")
