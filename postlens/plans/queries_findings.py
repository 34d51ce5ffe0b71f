"""Amplification, findings, brief and review tables over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import amplification as A
from postlens.operators import brief, clean, eda, profile, review, sentiment, topics
from postlens.plans import bind as B, queries_text  # noqa: F401  (its subqueries are used here)
from postlens.plans.bind import half_even, pct
from postlens.plans.catalog import cte, query
from postlens.plans.queries_eda import clean_counts
from postlens.plans.queries_topics import named_posts
from postlens.plans.run import Analysis, analyse_posts, analyse_topics
from postlens.schema import Thresholds
from postlens.seeds.patterns import LABELS
from postlens.seeds.phrases import phrase
from postlens.session import scratch_path
from postlens.sources.sinks import write_lines

TS = "yyyy-MM-dd HH:mm:ss"
SQL_TS = "'%Y-%m-%d %H:%M:%S'"


def rounded(column: str, digits: int):
    return (F.rint(F.col(column) * 10.0**digits) / 10.0**digits).alias(column)


# --- amplification ------------------------------------------------------------

cte(
    "post_amounts",
    "SELECT engagement AS v, row_number() OVER (ORDER BY engagement DESC) AS place, count(*) OVER () AS n FROM topic_posts",
    True,
)
cte(
    "proxy1",
    f"""SELECT true AS available, max(n) AS n_total, CAST(greatest(1, floor(0.05 * max(n))) AS BIGINT) AS n_top5pct,
        {pct("sum(CASE WHEN place <= greatest(1, floor(0.05 * n)) THEN CAST(v AS DECIMAL(18, 2)) END)",
             "sum(CAST(v AS DECIMAL(18, 2)))")} AS top5_share_pct,
        {half_even("quantile_cont(v, 0.5)", 4)} AS median_engagement, max(v) AS max_engagement FROM post_amounts""",
    True,
)


@query("proxy_engagement", "SELECT * FROM proxy1")
def proxy_engagement(spark, sf_dir):
    out = A.proxy_engagement(B.topic_posts(spark, sf_dir).select("engagement"))
    return out.withColumn("median_engagement", rounded("median_engagement", 4))


cte(
    "author_pct",
    f"""SELECT analyst_label AS topic, author, count(*) AS n,
        {half_even("count(*) / sum(count(*)) OVER (PARTITION BY analyst_label) * 100", 1)} AS pct
    FROM named_posts GROUP BY analyst_label, author""",
    True,
)


@query("author_shares", "SELECT * FROM author_pct")
def author_shares(spark, sf_dir):
    return A.author_shares(named_posts(spark, sf_dir)[0])


@query(
    "proxy_author",
    """SELECT topic, arg_min(author, struct_pack(p := -pct, a := author)) AS dominant_author, max(pct) AS pct,
        max(pct) >= 23 AS flagged FROM author_pct GROUP BY topic""",
)
def proxy_author(spark, sf_dir):
    return A.proxy_author(named_posts(spark, sf_dir)[0], threshold_pct=23.0)


cte("event_hours", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
cte("post_hours", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM topic_posts GROUP BY 1")


def _stats_sql(hours: str) -> str:
    return f"""SELECT count(*) >= 5 AS available, count(*) AS n_hours, {half_even("avg(n)", 2)} AS mean_per_hour,
        {half_even("stddev_samp(n)", 2)} AS std_per_hour, {half_even("avg(n) + 3 * stddev_samp(n)", 2)} AS threshold,
        (SELECT count(*) FROM {hours} WHERE n > (SELECT avg(n) + 3 * stddev_samp(n) FROM {hours})) AS burst_count
    FROM {hours}"""


cte("post_bursts", _stats_sql("post_hours"))


@query(
    "proxy_bursts",
    f"""SELECT strftime(hour, {SQL_TS}) AS hour, n FROM event_hours
    WHERE n > (SELECT avg(n) + 3 * stddev_samp(n) FROM event_hours) ORDER BY hour""",
)
def proxy_bursts(spark, sf_dir):
    return A.proxy_bursts(B.table(spark, sf_dir, "events")).select(F.date_format("hour", TS).alias("hour"), "n")


@query("burst_stats", _stats_sql("event_hours"))
def burst_stats(spark, sf_dir):
    return A.burst_stats(B.table(spark, sf_dir, "events"))


cte("text_groups", "SELECT text, count(*) AS n FROM topic_posts GROUP BY text", True)
cte(
    "proxy4",
    f"""SELECT true AS available, CAST(sum(n) AS BIGINT) AS n_valid,
        CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_count,
        {pct("coalesce(sum(n) FILTER (WHERE n > 1), 0)", "sum(n)")} AS duplicate_pct FROM text_groups""",
)


@query("proxy_duplication", "SELECT * FROM proxy4")
def proxy_duplication(spark, sf_dir):
    return A.proxy_duplication(B.topic_posts(spark, sf_dir).select("text"))


@query(
    "top_repeated",
    "SELECT left(text, 80) AS text, n FROM text_groups WHERE n > 1 ORDER BY n DESC, left(text, 80), sha256(text) LIMIT 5",
)
def top_repeated(spark, sf_dir):
    return A.top_repeated(B.topic_posts(spark, sf_dir).select("text"))


cte(
    "checklist",
    f"""SELECT 1 AS ord, 'high content duplication' AS name, duplicate_pct > 20 AS triggered,
        duplicate_pct || '% duplicate rate (threshold 20.0%)' AS evidence FROM proxy4
    UNION ALL SELECT 2, 'bot accounts present at scale', s > 10,
        'bot share ' || printf('%.2f', s) || '% (threshold 10.0%)'
        FROM (SELECT {pct("bot_rows", "starting_rows")} AS s FROM clean_counts)
    UNION ALL SELECT 3, 'regular timing intervals (account-level)', false,
        'requires account-level timestamp data; not available in this dataset'
    UNION ALL SELECT 4, 'cross-platform synchrony', false, 'requires cross-platform identity resolution; not available'
    UNION ALL SELECT 5, 'temporal bursts above 3σ', burst_count > 0, burst_count || ' bursts identified' FROM post_bursts
    UNION ALL SELECT 6, 'engagement concentration', top5_share_pct > 50,
        'top 5% carry ' || top5_share_pct || '% of total engagement' FROM proxy1""",
    True,
)
cte(
    "judgement",
    """SELECT *, CASE WHEN triggered_count >= 4 THEN 'HIGH' WHEN triggered_count >= 2 THEN 'MODERATE' ELSE 'LOW' END
            AS coordination_confidence,
        CASE WHEN triggered_count >= 4 THEN 'four or more checks hold at once, which is hard to explain by chance'
             WHEN triggered_count >= 2 THEN 'two or three checks hold, and others could not be made'
             ELSE 'at most one check holds' END AS confidence_reason
    FROM (SELECT count(*) FILTER (WHERE triggered) AS triggered_count,
        count(*) FILTER (WHERE NOT contains(evidence, 'not available')) AS available_count, count(*) AS total_count
        FROM checklist)""",
    True,
)


def _signals(spark, sf_dir):
    staged, once = B.topic_stages(spark, sf_dir)
    return A.coordination_for(staged, clean.bot_share(clean_counts(spark, sf_dir)), texts=once)


@query("coordination_signals", "SELECT * FROM checklist")
def coordination_signals(spark, sf_dir):
    return _signals(spark, sf_dir)


@query("coordination_verdict", "SELECT * FROM judgement")
def coordination_verdict(spark, sf_dir):
    return A.coordination_verdict(_signals(spark, sf_dir))


# --- findings -----------------------------------------------------------------

cte(
    "sentiment_matrix",
    "SELECT analyst_label AS topic, count(*) AS n, "
    + ", ".join(
        f"""{half_even(f"count(*) FILTER (WHERE final_label = '{x}')::DOUBLE / count(*) * 100", 1)} AS "{x}" """
        for x in LABELS
    )
    + " FROM named_posts GROUP BY analyst_label",
    True,
)


def _matrix(spark, sf_dir):
    return brief.topic_sentiment(named_posts(spark, sf_dir)[0])


@query("topic_sentiment", "SELECT * FROM sentiment_matrix")
def topic_sentiment(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query(
    "negative_rank",
    f"""SELECT topic, {half_even('"NEGATIVE" + "NEGATIVE-DISTRESS"', 1)} AS negative_pct FROM sentiment_matrix""",
)
def negative_rank(spark, sf_dir):
    return brief.negative_rank(_matrix(spark, sf_dir)).withColumn("negative_pct", rounded("negative_pct", 1))


@query("positive_rank", 'SELECT topic, "POSITIVE" AS positive_pct FROM sentiment_matrix')
def positive_rank(spark, sf_dir):
    return brief.positive_rank(_matrix(spark, sf_dir))


def analysis(spark, sf_dir) -> Analysis:
    staged, once = B.topic_stages(spark, sf_dir)
    return analyse_topics(staged, clean_counts(spark, sf_dir), "en", texts=once)


def _say(key: str) -> str:
    return phrase("en", key).replace("'", "''")


def _filled(key: str, *parts: str) -> str:
    """The phrase as a SQL concatenation, its printf slots replaced by SQL texts in argument order."""
    import re

    order = iter(range(len(parts)))

    def slot(match):
        at = int(match.group(1)[:-1]) - 1 if match.group(1) else next(order)
        return "' || " + parts[at] + " || '"

    text = re.sub(r"%(\d+\$)?(?:,d|\.1f|s)", slot, _say(key).replace("%%", "\0"))
    return "'" + text.replace("\0", "%") + "'"


def _top_topic(share: str) -> str:
    return f"""SELECT m.topic, share, coalesce(post_count, 0) AS posts, coalesce(NARRATIVE_STATEMENT,
            '{_say("no_narrative")}') AS stmt, coalesce(ACTOR, '{_say("needs_human")}') AS actor
        FROM (SELECT topic, {share} AS share FROM sentiment_matrix) m LEFT JOIN stories s ON s.analyst_label = m.topic
        WHERE share > 0 ORDER BY share DESC, m.topic LIMIT 1"""


LEVEL = "CASE coordination_confidence " + " ".join(f"WHEN '{k}' THEN '{_say(k)}'" for k in ("HIGH", "MODERATE", "LOW")) + " END"
SHARE, POSTS = "printf('%.1f', share)", "format('{:,}', posts)"
cte(
    "found",
    f"""SELECT 1 AS ord, {_filled("title_neg", "topic")} AS title, {_filled("bluf_neg", "topic", POSTS, SHARE)} AS bluf,
        {_filled("evidence_topic", SHARE, "stmt")} AS evidence, 'MODERATE' AS confidence,
        '{_say("reason_neg")}' AS confidence_reason, '{_say("lim_neg_1")}|{_say("lim_neg_2")}' AS limitations,
        {_filled("rec_neg", "topic", "actor")} AS recommendation, topic AS related_topics
    FROM ({_top_topic('"NEGATIVE" + "NEGATIVE-DISTRESS"')})
    UNION ALL SELECT 2, {_filled("title_pos", "topic")}, {_filled("bluf_pos", "topic", POSTS, SHARE)},
        {_filled("evidence_topic", SHARE, "stmt")}, 'MODERATE', '{_say("reason_pos")}',
        '{_say("lim_pos_1")}|{_say("lim_pos_2")}', {_filled("rec_pos", "topic")}, topic FROM ({_top_topic('"POSITIVE"')})
    UNION ALL SELECT 3, {_filled("title_amp", LEVEL)},
        {_filled("bluf_amp", "triggered_count", "total_count", "(SELECT top5_share_pct FROM proxy1)",
                 "(SELECT duplicate_pct FROM proxy4)")},
        {_filled("evidence_amp", "(SELECT string_agg(name || CASE WHEN triggered THEN ' ✓' ELSE ' ✗' END, '; ' ORDER BY ord)"
                 " FROM checklist WHERE NOT contains(evidence, 'not available'))")},
        coordination_confidence, confidence_reason, '{_say("lim_amp_1")}|{_say("lim_amp_2")}', '{_say("rec_amp")}', ''
    FROM judgement WHERE triggered_count >= 1""",
    True,
)


@query("findings", "SELECT * FROM found")
def findings(spark, sf_dir):
    return analysis(spark, sf_dir).findings.withColumns(
        {
            "limitations": F.array_join("limitations", "|"),
            "related_topics": F.array_join("related_topics", "|"),
        }
    )


@query("recommendations", "SELECT ord, confidence, recommendation FROM found")
def recommendations(spark, sf_dir):
    return brief.recommendations(analysis(spark, sf_dir).findings)


cte(
    "gap_shares",
    f"""SELECT {half_even("count(*) FILTER (WHERE text IS NULL OR length(text) < 400)::DOUBLE / count(*) * 100", 1)} AS p
    FROM posts""",
)


@query(
    "limitations",
    f"""SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS ord, line FROM (
        SELECT 1 AS k, {_filled("gap", "'engagement'", "p")} AS line FROM gap_shares WHERE p > 0
        UNION ALL SELECT 2, '{_say("no_author")}'
        UNION ALL SELECT * FROM (VALUES {", ".join(f"({2 + i}, '{_say(f'standing_{i}')}')" for i in range(1, 5))}))""",
)
def limitations(spark, sf_dir):
    """Posts without an author column, and without engagement where the text is short."""
    posts = B.posts(spark, sf_dir).drop("author")
    return brief.limitations(posts.withColumn("engagement", F.when(F.length("text") >= 400, F.col("engagement"))), "en")


def _brief_lines(spark, sf_dir):
    done = analysis(spark, sf_dir)
    return brief.brief_lines(
        done.topics,
        done.matrix,
        done.narratives,
        done.findings,
        done.engagement,
        A.proxy_author(done.topics),
        done.bursts,
        done.duplication,
        done.verdict,
        "en",
        run_date="2024-01-31",
    )


@query("brief_lines")
def brief_lines(spark, sf_dir):
    return _brief_lines(spark, sf_dir)


@query("sink_text")
def sink_text(spark, sf_dir):
    path = scratch_path(spark, "brief")
    write_lines(_brief_lines(spark, sf_dir), path)
    return spark.read.text(path)


# --- review -------------------------------------------------------------------


def _queue(spark, sf_dir):
    roles = profile.infer_roles(profile.profile_columns(B.raw_table(spark, sf_dir)))
    skewed = eda.eda_skew_rule(B.posts(spark, sf_dir).drop("platform").withColumnRenamed("lang", "platform"))
    staged, once = B.topic_stages(spark, sf_dir)
    drafts = topics.auto_label(once, topics.top_keywords(topics.ctfidf(once, copies="copies")))
    labelled = B.labelled(spark, sf_dir)
    return review.review_queue(
        review.schema_question(roles),
        review.skew_question(skewed),
        review.calibration_question(
            sentiment.sentiment_summary(labelled), sentiment.calibration_sample(labelled)
        ),
        review.topic_question(topics.topic_summary(staged), drafts),
    )


cte(
    "asked",
    """SELECT 'schema-run' AS question_id, 'schema_infer' AS stage, 'confirm' AS question_type, true AS blocks_stage,
        'roles are a guess from names and values' AS why_asking
    UNION ALL SELECT 'eda-skew-run', 'eda', 'open', false, 'one platform, ' || lang || ', holds over 60% of the posts'
        FROM posts GROUP BY lang HAVING count(*) * 100.0 / (SELECT count(*) FROM posts) > 60
    UNION ALL SELECT 'sentiment-calibrate-run', 'sentiment', 'calibrate', false,
        'labels differ on ' || disagreement_pct || '% of the posts, limit 15.0%' FROM sentiment_counts WHERE disagreement_pct > 15
    UNION ALL SELECT 'topic-label-run', 'topic', 'label', true, count(*) || ' topics without a name'
        FROM drafts WHERE topic_id <> -1 HAVING count(*) > 0""",
    True,
)


@query("review_queue", "SELECT * FROM asked")
def review_queue(spark, sf_dir):
    return _queue(spark, sf_dir).select("question_id", "stage", "question_type", "blocks_stage", "why_asking")


def _answers(spark, sf_dir):
    """Every click is an answer to the question of its user; signups reject it."""
    events = B.table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("question_id"),
        F.col("props").alias("response"),
        (F.col("event_type") != "signup").alias("approved"),
        F.col("ts").alias("timestamp"),
    ).where(F.col("event_type").isin("click", "signup"))


@query(
    "apply_answers",
    """SELECT 'q' || user_id AS question_id, arg_max(props, struct_pack(t := ts, p := props)) AS response FROM events
    WHERE event_type = 'click' GROUP BY user_id""",
)
def apply_answers(spark, sf_dir):
    return review.applied_answers(_answers(spark, sf_dir))


@query(
    "pending_questions",
    """SELECT 'q' || event_id AS question_id FROM events
    WHERE event_id NOT IN (SELECT user_id FROM events WHERE event_type IN ('click', 'signup'))""",
)
def pending_questions(spark, sf_dir):
    queue = B.table(spark, sf_dir, "events").select(F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("question_id"))
    return review.pending_questions(queue, _answers(spark, sf_dir))


cte(
    "measured",
    f"""SELECT 'bot_quarantine_pct' AS metric, {pct("bot_rows", "starting_rows")} AS value, 10.0::DOUBLE AS threshold FROM clean_counts
    UNION ALL SELECT 'outlier_rerun_pct', {pct("coalesce(sum(size) FILTER (WHERE topic_id = -1), 0)", "sum(size)")}, 5.0
        FROM size_by_topic
    UNION ALL SELECT 'duplication_alarm_pct', duplicate_pct, 20.0 FROM proxy4""",
)


@query("threshold_alarms", "SELECT *, value > threshold AS alarm FROM measured")
def threshold_alarms(spark, sf_dir):
    staged, once = B.topic_stages(spark, sf_dir)
    values = review.metrics(
        staged,
        bot_quarantine_pct=clean.bot_share(clean_counts(spark, sf_dir)),
        outlier_rerun_pct=topics.topic_summary(staged).select("outlier_pct").scalar(),
        duplication_alarm_pct=A.proxy_duplication(once, "copies").select("duplicate_pct").scalar(),
    )
    return review.threshold_alarms(values, Thresholds(outlier_rerun_pct=5.0))


@query("analyse")
def analyse(spark, sf_dir):
    """The whole pipeline over all posts of the test tables, from cleaning to findings."""
    posts = B.posts(spark, sf_dir).drop("lang")
    return analyse_posts(posts, bot_labels=list(B.BOT_AUTHORS)).findings.withColumns(
        {"limitations": F.array_join("limitations", "|"), "related_topics": F.array_join("related_topics", "|")}
    )
