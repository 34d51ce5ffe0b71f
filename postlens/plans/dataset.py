"""A raw file to its report in one call: load, profile, roles, gate, analysis, answers, audit rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.operators import amplification, brief, clean, eda, prepare, profile, reshape, review, sentiment, topics
from postlens.plans import run
from postlens.schema import CANONICAL_NAMES, DatasetRoles, Thresholds
from postlens.seeds.words import SARCASM_SEEDS
from postlens.session import scratch_path, stored
from postlens.sources import readers, sinks

# The stages of a run in order.
STAGES = (
    "ingest", "schema_infer", "reshape", "eda", "clean", "preprocess", "sentiment", "topic", "narrative",
    "amplification", "brief",
)


@dataclass
class Run:
    """Where a run stands: its stages as written tables, its audit rows, its questions, its results."""

    spark: SparkSession
    folder: str
    run_id: str = "run"
    stages: dict[str, sinks.StageResult] = field(default_factory=dict)
    entries: list[DataFrame] = field(default_factory=list)
    questions: list[DataFrame] = field(default_factory=list)
    roles: DatasetRoles | None = None
    analysis: run.Analysis | None = None
    lines: DataFrame | None = None

    def keep(self, stage: str, df: DataFrame, action: str, reason: str = "") -> DataFrame:
        """Writes a stage once; its audit row takes count and fingerprint from that write, without another scan."""
        result = sinks.write_stage(df, f"{self.folder}/{stage}")
        self.stages[stage] = result
        self.entries.append(sinks.audit_entry(self.spark, stage, action, result.n_rows, reason, result.path, result.digest))
        return result.df

    def finish(self) -> None:
        """Appends all audit rows of the run in one write."""
        rows = self.entries[0]
        for entry in self.entries[1:]:
            rows = rows.unionByName(entry)
        sinks.audit_append(rows.coalesce(1), self.audit_path)
        self.entries = []

    @property
    def audit_path(self) -> str:
        return f"{self.folder}/audit"

    def queue(self) -> DataFrame:
        return review.review_queue(*self.questions)


def no_answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "question_id string, response string, approved boolean, timestamp timestamp")


def confirmed_roles(proposed: DataFrame, language: str, answers: DataFrame, run_id: str) -> DatasetRoles:
    """The roles of the latest approved schema answer, else the proposed ones (one row).

    An approved answer without a body accepts the proposal. One that was only
    ever rejected stops the run, as its columns are nobody's choice.
    """
    mine = answers.where(F.col("question_id") == f"schema-{run_id}")
    latest = mine.orderBy(F.desc("timestamp"), F.desc("response")).limit(1).collect()
    if latest and not latest[0]["approved"] and review.applied_answers(mine).isEmpty():
        raise ValueError("the proposed schema was rejected; answer the question with the right columns")
    chosen = proposed.first().asDict()
    given = review.schema_answer(mine, [*CANONICAL_NAMES, "language"]).first()
    if given:
        chosen |= {role: value for role, value in given.asDict().items() if value is not None}
    return DatasetRoles(
        id_col=chosen["id_col"],
        text_col=chosen["text_col"],
        language=chosen.get("language") or language,
        timestamp_col=chosen.get("timestamp_col"),
        author_col=chosen.get("author_col"),
        engagement_col=chosen.get("engagement_col"),
        platform_col=chosen.get("platform_col"),
    )


def analyse_file(
    spark: SparkSession,
    path: str,
    folder: str | None = None,
    answers: DataFrame | None = None,
    language: str | None = None,
    roles: DatasetRoles | None = None,
    thresholds: Thresholds = Thresholds(),
    lexicons=None,
    bot_labels=None,
    detector: Callable | None = None,
    min_rows: int = topics.MIN_ROWS,
    run_id: str = "run",
    **topic_options,
) -> Run:
    """Reads a raw file or folder and runs all eleven stages; answers (question_id, response, approved, timestamp) take effect.

    Without answers the proposed roles and draft labels stand. A column that
    mostly fails to parse, or a table without a text column, stops the run.
    """
    answers = no_answers(spark) if answers is None else answers
    state = Run(spark, folder or scratch_path(spark, "dataset"), run_id)
    loaded = readers.load_dataset(spark, path)
    cores = spark.sparkContext.defaultParallelism
    if loaded.rdd.getNumPartitions() < cores:  # a small or compressed file is a single split
        loaded = loaded.repartition(cores)
    raw = state.keep("ingest", loaded, "load", path)

    profiles = state.keep("schema_infer", profile.require_text(profile.profile_columns(raw)), "profile")
    if roles is None:
        proposed = profile.infer_roles(profiles)
        guess = profile.infer_language(profiles, F.lit(proposed.first()["text_col"])).first()
        proposed = proposed.withColumn("language", F.lit(language or guess["language"]))
        state.questions.append(review.schema_question(proposed, run_id))
        roles = confirmed_roles(proposed, language or guess["language"], answers, run_id)
    state.roles = roles

    shaped = reshape.enforce_parse_gate(reshape.canonical_posts(raw, roles))
    posts = state.keep("reshape", shaped, "rename", ", ".join(f"{k}->{v}" for k, v in roles.renames().items()))

    state.keep("eda", eda.text_length_summary(posts), "summarise")
    if "platform" in posts.columns:
        state.questions.append(review.skew_question(eda.eda_skew_rule(posts), run_id))

    streamed = clean.clean_posts(posts, bot_labels) if bot_labels else clean.clean_posts(posts)
    streamed = state.keep("clean", streamed, "split streams")
    summary = clean.clean_summary(posts, streamed)
    organic = clean.organic_stream(streamed)
    prepared = prepare.prepare_posts(organic, roles.language, detector=detector or prepare.language_by_words)
    prepared = state.keep("preprocess", prepared, "normalise and tokenise", roles.language)

    labelled = sentiment.label_posts(prepared, lexicons, SARCASM_SEEDS)
    labelled = state.keep("sentiment", labelled, "label")
    disputed = sentiment.calibration_sample(labelled)
    state.questions.append(review.calibration_question(sentiment.sentiment_summary(labelled), disputed, run_id=run_id))

    corpus = topics.topic_corpus(labelled)
    gate = topics.topic_gate(corpus, min_rows)
    if gate.where("skipped").isEmpty():
        clustered = topics.fit_topics(corpus, min_topic_size=thresholds.min_topic_size, **topic_options)
    else:
        clustered = corpus.withColumn("topic_id", F.lit(topics.OUTLIER))
    clustered = state.keep("topic", clustered, "cluster")
    drafts = topics.auto_label(clustered, topics.top_keywords(topics.ctfidf(clustered)))
    state.questions.append(review.topic_question(topics.topic_summary(clustered), drafts, run_id))
    named = review.topic_label_answers(state.queue(), answers)

    report = "en" if roles.language == "auto" else roles.language
    result = run.analyse_topics(clustered, stored(summary, "clean-summary"), report, thresholds, labels=named)
    state.keep("narrative", result.narratives, "narratives")
    state.keep("amplification", result.signals, "signals")
    state.keep("brief", result.findings, "findings")
    state.analysis = replace(result, gate=gate)
    # Without authors or times the report says so; the lines on them have nothing to count.
    authors = amplification.proxy_author(result.topics) if "author" in posts.columns else spark.createDataFrame([], "flagged boolean")
    bursts = spark.createDataFrame([], "burst_count bigint") if result.bursts is None else result.bursts
    state.lines = brief.brief_lines(
        result.topics, result.matrix, result.narratives, result.findings, result.engagement,
        authors, bursts, result.duplication, result.verdict, report,
        run_id=run_id, dataset=path, sigma=thresholds.burst_sigma,
    )
    state.finish()
    return state
