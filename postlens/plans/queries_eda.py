"""Exploratory statistics, chart data and cleaning over the test tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from postlens.operators import clean, eda
from postlens.plans import bind as B
from postlens.plans.bind import half_even, pct
from postlens.plans.catalog import cte, query

TS = "yyyy-MM-dd HH:mm:ss"
SQL_TS = "'%Y-%m-%d %H:%M:%S'"
AS_OF = datetime.datetime(2024, 1, 15, 12, 0, 0)
NUMPY_WIDTH = "(hi - lo) / 40"


def rounded(column: str, digits: int):
    return (F.rint(F.col(column) * 10.0**digits) / 10.0**digits).alias(column)


def _events_as_posts(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("value").alias("engagement"), F.col("event_type").alias("platform")
    )


cte(
    "bins_6h",
    """SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') AS bin_start, count(*) AS n_posts
    FROM events GROUP BY 1""",
)


@query(
    "temporal_summary",
    f"""SELECT strftime(min(ts), {SQL_TS}) AS "start", strftime(max(ts), {SQL_TS}) AS "end",
        {half_even("date_diff('microsecond', min(ts), max(ts)) / 86400000000.0", 2)} AS duration_days,
        (SELECT strftime(bin_start, {SQL_TS}) FROM bins_6h ORDER BY n_posts DESC, bin_start LIMIT 1) AS peak_6h_window,
        (SELECT max(n_posts) FROM bins_6h) AS peak_6h_count FROM events""",
)
def temporal_summary(spark, sf_dir):
    out = eda.temporal_summary(_events_as_posts(spark, sf_dir))
    shown = [F.date_format(c, TS).alias(c) for c in ("start", "end", "peak_6h_window")]
    return out.select(*shown, "duration_days", "peak_6h_count")


@query(
    "volume_6h",
    f"""SELECT strftime(g, {SQL_TS}) AS bin_start, coalesce(n_posts, 0) AS n_posts
    FROM (SELECT unnest(generate_series(min(bin_start), max(bin_start), INTERVAL 6 HOURS)) AS g FROM bins_6h)
    LEFT JOIN bins_6h ON bin_start = g""",
)
def volume_6h(spark, sf_dir):
    return eda.volume_6h(_events_as_posts(spark, sf_dir)).select(
        F.date_format("bin_start", TS).alias("bin_start"), "n_posts"
    )


cte("platform_counts", "SELECT platform AS value, count(*) AS n FROM posts WHERE platform IS NOT NULL GROUP BY 1")


@query(
    "categorical_summary",
    f"""SELECT value, n, {pct("n", "(SELECT sum(n) FROM platform_counts)")} AS pct,
        (SELECT count(*) FROM platform_counts) AS n_unique FROM platform_counts ORDER BY n DESC, value LIMIT 10""",
)
def categorical_summary(spark, sf_dir):
    return eda.categorical_summary(B.posts(spark, sf_dir), "platform")


cte("amounts", "SELECT value AS v, row_number() OVER (ORDER BY value DESC) AS place, count(*) OVER () AS n FROM events")


@query(
    "engagement_summary",
    f"""SELECT count(*) AS "count", {half_even("quantile_cont(v, 0.5)", 4)} AS median, {half_even("avg(v)", 4)} AS mean,
        max(v) AS "max", {half_even("quantile_cont(v, 0.99)", 4)} AS p99,
        count(*) FILTER (WHERE v = 0) AS zero_count,
        {pct("sum(CASE WHEN place <= greatest(1, floor(0.05 * n)) THEN CAST(v AS DECIMAL(18, 2)) END)",
             "sum(CAST(v AS DECIMAL(18, 2)))")} AS top5_share_pct FROM amounts""",
)
def engagement_summary(spark, sf_dir):
    out = eda.engagement_summary(_events_as_posts(spark, sf_dir))
    return out.select(
        "count", rounded("median", 4), rounded("mean", 4), "max", rounded("p99", 4), "zero_count", "top5_share_pct"
    )


@query(
    "top5_share",
    f"""SELECT max(n) AS n, CAST(greatest(1, floor(0.05 * max(n))) AS BIGINT) AS k,
        {pct("sum(CASE WHEN place <= greatest(1, floor(0.05 * n)) THEN CAST(v AS DECIMAL(18, 2)) END)",
             "sum(CAST(v AS DECIMAL(18, 2)))")} AS top5_share_pct FROM amounts""",
)
def top5_share(spark, sf_dir):
    return eda.top5_share(_events_as_posts(spark, sf_dir))


@query(
    "text_length_summary",
    f"""SELECT {half_even("avg(length(text))", 1)} AS mean, CAST(max(length(text)) AS INTEGER) AS "max",
        count(*) FILTER (WHERE length(text) < 5) AS very_short_lt5,
        count(*) FILTER (WHERE length(text) > 200) AS very_long_gt200,
        CAST(floor(quantile_cont(length(text), 0.5)) AS INTEGER) AS median FROM posts""",
)
def text_length_summary(spark, sf_dir):
    return eda.text_length_summary(B.posts(spark, sf_dir))


@query(
    "composite_dup_count",
    """SELECT CAST(sum(n - 1) AS BIGINT) AS composite_dup_count
    FROM (SELECT count(*) AS n FROM member_posts GROUP BY platform, id)""",
)
def composite_dup_count(spark, sf_dir):
    return eda.composite_dup_count(B.member_posts(spark, sf_dir))


@query(
    "content_dup_count",
    """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS content_dup_count
    FROM (SELECT count(*) AS n FROM posts GROUP BY text HAVING count(*) > 1)""",
)
def content_dup_count(spark, sf_dir):
    return eda.content_dup_count(B.posts(spark, sf_dir))


@query(
    "empty_text_count",
    "SELECT count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS empty_text_count FROM member_posts",
)
def empty_text_count(spark, sf_dir):
    return eda.empty_text_count(B.member_posts(spark, sf_dir))


@query(
    "future_ts_count",
    "SELECT count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-15 12:00:00') AS future_ts_count FROM events",
)
def future_ts_count(spark, sf_dir):
    return eda.future_ts_count(_events_as_posts(spark, sf_dir), AS_OF)


@query(
    "quality_summary",
    """SELECT (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM member_posts GROUP BY platform, id))
            AS composite_dup_count,
        (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM member_posts WHERE text IS NOT NULL
            GROUP BY text HAVING count(*) > 1)) AS content_dup_count,
        count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS empty_text_count,
        count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-15 12:00:00') AS future_ts_count FROM member_posts""",
)
def quality_summary(spark, sf_dir):
    return eda.quality_summary(B.member_posts(spark, sf_dir), AS_OF)


@query(
    "eda_skew_rule",
    f"""SELECT * FROM (SELECT lang AS platform, count(*) AS n,
        {pct("count(*)", "(SELECT count(*) FROM documents)")} AS pct FROM documents GROUP BY lang)
    WHERE pct > 60""",
)
def eda_skew_rule(spark, sf_dir):
    # Language as the platform: English holds more than 60 % of the documents.
    return eda.eda_skew_rule(B.table(spark, sf_dir, "documents").withColumnRenamed("lang", "platform"))


@query(
    "chart_categories",
    """SELECT 'platform' AS field, platform AS value, count(*) AS n, false AS is_bot FROM posts GROUP BY platform
    UNION ALL SELECT 'author', author, count(*), author IN ('疑似機器人', 'suspected_bot', 'bot') FROM posts
    GROUP BY author""",
)
def chart_categories(spark, sf_dir):
    return eda.chart_categories(B.posts(spark, sf_dir))


@query(
    "chart_engagement_hist",
    f"""SELECT CAST(b AS INTEGER) AS bin, {half_even("lo + (hi - lo) / 50 * (b - 1)", 6)} AS bin_lo,
        {half_even("lo + (hi - lo) / 50 * b", 6)} AS bin_hi,
        (SELECT count(*) FROM events WHERE least(CAST(floor((value - lo) / (hi - lo) * 50) AS INTEGER) + 1, 50) = b) AS n
    FROM (SELECT min(value) AS lo, max(value) AS hi FROM events), (SELECT unnest(generate_series(1, 50)) AS b)""",
)
def chart_engagement_hist(spark, sf_dir):
    out = eda.chart_engagement_hist(_events_as_posts(spark, sf_dir))
    return out.select("bin", rounded("bin_lo", 6), rounded("bin_hi", 6), "n")


cte("under_cap", "SELECT * FROM posts WHERE engagement <= (SELECT quantile_cont(engagement, 0.95) FROM posts)")


@query(
    "chart_engagement_box",
    f"""SELECT platform, count(*) AS n, min(engagement) AS low, {half_even("quantile_cont(engagement, 0.25)", 4)} AS q1,
        {half_even("quantile_cont(engagement, 0.5)", 4)} AS median, {half_even("quantile_cont(engagement, 0.75)", 4)} AS q3,
        max(engagement) AS high FROM under_cap GROUP BY platform""",
)
def chart_engagement_box(spark, sf_dir):
    out = eda.chart_engagement_box(B.posts(spark, sf_dir))
    return out.select("platform", "n", "low", rounded("q1", 4), rounded("median", 4), rounded("q3", 4), "high")


cte(
    "lengths",
    """SELECT platform, length(text)::DOUBLE AS len, min(length(text)) OVER (PARTITION BY platform)::DOUBLE AS lo,
        max(length(text)) OVER (PARTITION BY platform)::DOUBLE AS hi, count(*) OVER (PARTITION BY platform) AS total
    FROM posts""",
)


@query(
    "chart_length_hist",
    f"""SELECT platform, quantile AS platform_median, bin, {half_even(f"lo + {NUMPY_WIDTH} * (bin - 1)", 6)} AS bin_lo,
        {half_even(f"lo + {NUMPY_WIDTH} * bin", 6)} AS bin_hi, count(*) AS n,
        {half_even(f"count(*) / (total * {NUMPY_WIDTH})", 8)} AS density
    FROM (SELECT *, least(CAST(floor((len - lo) / (hi - lo) * 40) AS INTEGER) + 1, 40) AS bin FROM lengths)
    JOIN (SELECT platform, quantile_cont(length(text), 0.5) AS quantile FROM posts GROUP BY platform) USING (platform)
    GROUP BY platform, quantile, bin, lo, hi, total""",
)
def chart_length_hist(spark, sf_dir):
    out = eda.chart_length_hist(B.posts(spark, sf_dir))
    return out.select(
        "platform", "platform_median", "bin", rounded("bin_lo", 6), rounded("bin_hi", 6), "n", rounded("density", 8)
    )


@query(
    "chart_top_posts",
    """SELECT id, platform, author, engagement, left(platform, 3) || ' | ' || left(text, 40) || '...' AS label
    FROM posts ORDER BY engagement DESC, id LIMIT 15""",
)
def chart_top_posts(spark, sf_dir):
    return eda.chart_top_posts(B.posts(spark, sf_dir))


# --- clean --------------------------------------------------------------------


def _streams(spark, sf_dir):
    return clean.clean_posts(B.member_posts(spark, sf_dir), B.BOT_AUTHORS, B.member_order())


@query("dedup_keep_first", "SELECT platform, id, seq, text FROM member_streams")
def dedup_keep_first(spark, sf_dir):
    return clean.dedup_keep_first(B.member_posts(spark, sf_dir), B.member_order()).select(
        "platform", "id", "seq", "text"
    )


@query("quarantine_split", "SELECT seq, id, author FROM member_streams WHERE stream = 'quarantine'")
def quarantine_split(spark, sf_dir):
    return clean.quarantine_stream(_streams(spark, sf_dir)).select("seq", "id", "author")


@query("bot_split", "SELECT seq, id, author FROM member_streams WHERE stream = 'bots'")
def bot_split(spark, sf_dir):
    return clean.bot_stream(_streams(spark, sf_dir)).select("seq", "id", "author")


@query("organic_stream", "SELECT seq, id, author, text FROM member_streams WHERE stream = 'organic'")
def organic_stream(spark, sf_dir):
    return clean.organic_stream(_streams(spark, sf_dir)).select("seq", "id", "author", "text")


cte(
    "clean_counts",
    f"""SELECT *, {pct("organic_rows", "starting_rows")} AS organic_pct FROM (
        SELECT count(*) FILTER (WHERE stream = 'organic') AS organic_rows,
               count(*) FILTER (WHERE stream = 'quarantine') AS quarantine_rows,
               count(*) FILTER (WHERE stream = 'bots') AS bot_rows,
               (SELECT count(*) FROM member_posts) AS starting_rows FROM member_streams)""",
)


def clean_counts(spark, sf_dir):
    return clean.clean_summary(B.member_posts(spark, sf_dir), _streams(spark, sf_dir))


@query("clean_summary", "SELECT * FROM clean_counts")
def clean_summary(spark, sf_dir):
    return clean_counts(spark, sf_dir)


@query(
    "bot_alarm",
    f"""SELECT {pct("bot_rows", "starting_rows")} AS bot_share_pct, 0.1::DOUBLE AS threshold_pct,
        bot_rows * 100.0 / starting_rows > 0.1 AS bot_alarm FROM clean_counts""",
)
def bot_alarm(spark, sf_dir):
    return clean.bot_alarm(clean_counts(spark, sf_dir), 0.1)


@query("bot_share", f"""SELECT {pct("bot_rows", "starting_rows")} AS bot_share_pct FROM clean_counts""")
def bot_share(spark, sf_dir):
    return clean.bot_share_table(clean_counts(spark, sf_dir))
