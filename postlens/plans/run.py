"""The whole analysis of one canonical post table as linked stages."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from postlens.operators import amplification, brief, clean, narrative, prepare, sentiment, topics
from postlens.schema import Thresholds
from postlens.seeds.words import SARCASM_SEEDS
from postlens.session import drop_stored, stored

TEXT_ID, VALID = "postlens_text_id", "postlens_text_valid"


@dataclass(frozen=True)
class Analysis:
    topics: DataFrame
    matrix: DataFrame
    narratives: DataFrame
    engagement: DataFrame
    bursts: DataFrame | None
    duplication: DataFrame
    signals: DataFrame
    verdict: DataFrame
    findings: DataFrame
    gate: DataFrame | None = None


def analyse_topics(
    staged: DataFrame,
    clean_summary: DataFrame,
    language: str,
    thresholds: Thresholds = Thresholds(),
    labels: DataFrame | None = None,
    texts: DataFrame | None = None,
) -> Analysis:
    """From posts with topic_id and final_label to findings.

    ``staged`` feeds several results, so give it as a written stage, or one joined with its written texts. ``texts``
    are its texts once each with their number of posts (topic_id, text,
    tokens_lem_str, copies); without it they are taken from the posts. The
    results in between have one row per topic or fewer; those used more than
    once are written too, so that no heavy step is planned twice.
    """
    once, copies = (staged, None) if texts is None else (texts, "copies")
    drafts = stored(topics.auto_label(once, topics.top_keywords(topics.ctfidf(once, copies=copies))), "draft-labels")
    if labels is not None:
        renamed = drafts.withColumnRenamed("auto_label", "analyst_label")
        drafts = stored(topics.apply_labels(renamed, labels).withColumnRenamed("analyst_label", "auto_label"), "labels")
    named = topics.with_labels(staged, drafts)
    stories = stored(
        narrative.narrative_table(narrative.narrative_evidence(named, drafts), drafts, language), "narratives"
    )
    matrix = stored(brief.topic_sentiment(named), "topic-sentiment")
    engagement = stored(amplification.proxy_engagement(named), "proxy-engagement")
    duplication = stored(amplification.proxy_duplication(named if texts is None else texts, copies), "proxy-duplication")
    bursts = stored(amplification.burst_stats(named, thresholds.burst_sigma), "bursts") if "ts" in named.columns else None
    signals = stored(
        amplification.coordination_signals(
            engagement,
            bursts,
            duplication,
            clean.bot_share(clean_summary),
            thresholds.duplication_alarm_pct,
            thresholds.bot_quarantine_pct,
        ),
        "signals",
    )
    verdict = amplification.coordination_verdict(signals)
    found = brief.findings(matrix, stories, signals, verdict, engagement, duplication, language)
    return Analysis(named, matrix, stories, engagement, bursts, duplication, signals, verdict, found)


def number_texts(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts with TEXT_ID instead of text, the distinct texts with TEXT_ID in the order of the texts), both written.

    What is made of a text is then made once, and no step on posts moves texts. Posts without a text have no number.
    """
    texts = posts.select("text").where(F.col("text").isNotNull()).distinct()
    texts = stored(texts.orderBy("text").select(F.monotonically_increasing_id().alias(TEXT_ID), "text"), "texts")
    digest = F.unhex(F.sha2("text", 256)).alias("text_digest")
    slim = posts.select(*[c for c in posts.columns if c != "text"], digest)
    valid = clean.is_valid_text(F.col("text")).alias(VALID)
    return stored(slim.join(texts.select(digest, TEXT_ID, valid), "text_digest", "left").drop("text_digest"), "slim-posts"), texts


def label_texts(
    posts: DataFrame,
    language: str = "auto",
    lexicons=None,
    bot_labels=None,
    detector=prepare.language_by_words,
    domain_patterns=SARCASM_SEEDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean posts, prepare and label their texts: (organic posts with TEXT_ID, labelled texts, clean summary)."""
    require_text(posts)
    slim, texts = number_texts(posts)
    # The numbers of texts are in the order of the texts.
    order = [F.asc_nulls_last("ts")] if "ts" in posts.columns else []
    order += [F.asc(c) for c in ("engagement", "author", TEXT_ID) if c in slim.columns]
    streamed = clean.clean_posts(slim, bot_labels or tuple(clean.BOT_LABELS), order, F.coalesce(VALID, F.lit(False)))
    prepared = prepare.prepare_posts(texts, language, detector=detector)
    labelled = sentiment.label_posts(prepared, lexicons, domain_patterns)
    # Both columns are made of the tokens again when read.
    written = stored(labelled.drop("tokens_lem_str", "token_count"), "labelled-texts")
    drop_stored(texts)
    return clean.organic_stream(streamed).drop(VALID), prepare.token_columns(written), clean.clean_summary(slim, streamed)


def with_texts(posts: DataFrame, texts: DataFrame, columns: list[str]) -> DataFrame:
    """The posts with all that their texts carry: ``columns`` first, as the posts had them, then what is new."""
    added = [c for c in texts.columns if c != TEXT_ID]
    whole = posts.drop(*added).join(texts, TEXT_ID)
    return whole.select(*columns, *[c for c in (*added, *posts.columns) if c not in columns and c != TEXT_ID])


def label_stage(
    posts: DataFrame,
    language: str = "auto",
    lexicons=None,
    bot_labels=None,
    detector=prepare.language_by_words,
    domain_patterns=SARCASM_SEEDS,
) -> tuple[DataFrame, DataFrame]:
    """Clean, prepare and label: (labelled organic posts, clean summary).

    With language 'auto', ``detector`` maps the text column of posts in Latin
    script to their language.
    """
    organic, texts, summary = label_texts(posts, language, lexicons, bot_labels, detector, domain_patterns)
    return with_texts(organic, texts, posts.columns), summary


def require_text(posts: DataFrame) -> None:
    if "text" not in posts.columns:
        raise ValueError("posts have no text column")


def analyse_posts(
    posts: DataFrame,
    language: str = "auto",
    thresholds: Thresholds = Thresholds(),
    lexicons=None,
    bot_labels=None,
    min_rows: int = topics.MIN_ROWS,
    **topic_options,
) -> Analysis:
    """Canonical posts to findings. With fewer than ``min_rows`` usable posts none is given a topic; ``gate`` says so."""
    organic, texts, summary = label_texts(posts, language, lexicons, bot_labels)
    texts = topics.topic_corpus(texts)
    corpus = stored(organic.join(texts.select(TEXT_ID), TEXT_ID, "left_semi"), "labelled")
    gate = stored(topics.topic_gate(corpus, min_rows), "topic-gate")
    if not gate.where("skipped").isEmpty():
        found = corpus.withColumn("topic_id", F.lit(topics.OUTLIER))
    elif topic_options.get("model") is None:
        found = topics.fit_topics(corpus, min_topic_size=thresholds.min_topic_size, texts=texts, key=TEXT_ID, **topic_options)
    else:
        found = topics.fit_topics(corpus.join(texts.select(TEXT_ID, "text_norm", "tokens_lem_str"), TEXT_ID), min_topic_size=thresholds.min_topic_size, **topic_options)
    found = stored(found.select(*corpus.columns, "topic_id"), "topics")
    uses = found.groupBy(TEXT_ID, "topic_id").agg(F.count(F.lit(1)).alias("copies"))
    once = texts.select(TEXT_ID, "text", "tokens_lem_str").join(uses, TEXT_ID).drop(TEXT_ID)
    report = "en" if language == "auto" else language
    staged = with_texts(found, texts, posts.columns)
    return replace(analyse_topics(staged, stored(summary, "clean-summary"), report, thresholds, texts=once), gate=gate)
