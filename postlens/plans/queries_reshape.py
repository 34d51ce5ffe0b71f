"""Canonical columns and recipe steps over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import reshape as R
from postlens.operators.reshape import ReshapeStep as Step
from postlens.plans import bind as B
from postlens.plans.catalog import cte, query
from postlens.schema import DatasetRoles

ROLES = DatasetRoles(
    id_col="post_id",
    text_col="body",
    language="en",
    timestamp_col="created_at",
    author_col="author_type",
    engagement_col="likes",
    platform_col="platform_name",
)
TS = "yyyy-MM-dd HH:mm:ss"


def _messy_events(spark, sf_dir):
    """Events as text, with two date layouts and some values that do not parse."""
    kind = F.col("event_type")
    return B.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(kind == "error", "n/a")
        .when(kind == "view", F.date_format("ts", "yyyy/MM/dd HH:mm"))
        .otherwise(F.date_format("ts", TS))
        .alias("ts"),
        F.when(kind == "signup", "many").otherwise(F.col("value").cast("string")).alias("engagement"),
        F.col("event_type").alias("platform"),
    )


cte(
    "messy_events",
    """SELECT event_id AS id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN date_trunc('minute', ts)
           ELSE date_trunc('second', ts) END AS ts,
           CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS engagement, event_type AS platform FROM events""",
)


def _shown(column):
    return F.date_format(column, TS)


def _events(spark, sf_dir):
    return B.table(spark, sf_dir, "events")


@query("canonical_rename", "SELECT post_id AS id, body AS text, created_at AS ts, likes AS engagement, "
       "platform_name AS platform, author_type AS author, tongue FROM raw_table")
def canonical_rename(spark, sf_dir):
    return R.canonical_rename(B.raw_table(spark, sf_dir), ROLES)


@query("cast_id", "SELECT CAST(event_id AS VARCHAR) AS id, event_type FROM events")
def cast_id(spark, sf_dir):
    return R.cast_id(_events(spark, sf_dir).select(F.col("event_id").alias("id"), "event_type"))


@query("parse_ts_utc", "SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM messy_events")
def parse_ts_utc(spark, sf_dir):
    return R.parse_ts_utc(_messy_events(spark, sf_dir)).select("id", _shown("ts").alias("ts"))


@query("coerce_engagement", "SELECT id, engagement FROM messy_events")
def coerce_engagement(spark, sf_dir):
    return R.coerce_engagement(_messy_events(spark, sf_dir)).select("id", "engagement")


@query(
    "reshape_summary",
    """SELECT count(*) AS row_count, CAST(7 AS INTEGER) AS column_count,
              'post_id->id, body->text, created_at->ts, author_type->author, likes->engagement, platform_name->platform'
              AS renames_applied, true AS ts_parsed, count(*) FILTER (WHERE ts IS NULL) AS ts_null_after_parse FROM posts""",
)
def reshape_summary(spark, sf_dir):
    return R.reshape_summary(R.canonical_posts(B.raw_table(spark, sf_dir), ROLES), ROLES)


@query(
    "parse_fail_gate",
    f"""SELECT 'ts' AS "column", {B.half_even("avg(CASE WHEN ts IS NULL THEN 1 ELSE 0 END) * 100", 6)} AS failed_pct,
               avg(CASE WHEN ts IS NULL THEN 1 ELSE 0 END) > 0.5 AS rejected FROM messy_events
    UNION ALL
    SELECT 'engagement', {B.half_even("avg(CASE WHEN engagement IS NULL THEN 1 ELSE 0 END) * 100", 6)},
               avg(CASE WHEN engagement IS NULL THEN 1 ELSE 0 END) > 0.5 FROM messy_events""",
)
def parse_fail_gate(spark, sf_dir):
    parsed = R.coerce_engagement(R.parse_ts_utc(_messy_events(spark, sf_dir)))
    return R.parse_fail_gate(parsed).withColumn("failed_pct", F.rint(F.col("failed_pct") * 1e6) / 1e6)


@query("op_rename", "SELECT doc_id, lang AS tongue, source FROM documents")
def op_rename(spark, sf_dir):
    return R.rename_column(
        B.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), Step("rename", ["lang"], "tongue")
    )


@query("op_concat", "SELECT conv_id, turn, role || ': ' || text AS post FROM conversations")
def op_concat(spark, sf_dir):
    chats = B.table(spark, sf_dir, "conversations")
    return R.concat_columns(chats, Step("concat", ["role", "text"], "post", {"sep": ": "})).select(
        "conv_id", "turn", "post"
    )


@query(
    "op_split",
    """SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS tongue FROM pages""",
)
def op_split(spark, sf_dir):
    step = Step("split", ["url"], params={"sep": "/", "targets": ["scheme", "empty", "host", "tongue"]})
    return R.split_column(B.table(spark, sf_dir, "pages"), step).select("page_id", "host", "tongue")


@query("op_parse_datetime", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS posted FROM events")
def op_parse_datetime(spark, sf_dir):
    parts = _events(spark, sf_dir).select(
        "event_id", F.date_format("ts", "dd.MM.yyyy").alias("d"), F.date_format("ts", "HH:mm:ss").alias("t")
    )
    step = Step("parse_datetime", ["d", "t"], "posted", {"format": "dd.MM.yyyy HH:mm:ss"})
    return R.parse_datetime(parts, step).select("event_id", _shown("posted").alias("posted"))


@query(
    "op_set_timezone",
    """SELECT event_id, strftime(ts - INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S') AS utc,
              strftime(ts + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S') AS taipei FROM events""",
)
def op_set_timezone(spark, sf_dir):
    stamped = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    attached = R.set_timezone(stamped, Step("set_timezone", ["ts"], "utc", {"zone": "Asia/Taipei"}))
    step = Step("set_timezone", ["ts"], "taipei", {"zone": "Asia/Taipei", "mode": "convert"})
    return R.set_timezone(attached, step).select("event_id", _shown("utc").alias("utc"), _shown("taipei").alias("taipei"))


@query("op_aggregate", "SELECT id, coalesce(engagement, 0) + id AS engagement FROM messy_events")
def op_aggregate(spark, sf_dir):
    parts = _messy_events(spark, sf_dir).withColumnRenamed("engagement", "likes").withColumn(
        "shares", F.col("id").cast("string")
    )
    return R.aggregate_columns(parts, Step("aggregate", ["likes", "shares"], "engagement")).select("id", "engagement")


@query(
    "op_aggregate_grouped",
    f"""SELECT platform, {B.half_even('sum(engagement)', 2)} AS engagement FROM messy_events GROUP BY platform""",
)
def op_aggregate_grouped(spark, sf_dir):
    step = Step("aggregate", ["engagement"], "engagement", {"by": ["platform"]})
    summed = R.aggregate_columns(_messy_events(spark, sf_dir), step)
    return summed.withColumn("engagement", F.rint(F.col("engagement") * 100) / 100)


@query(
    "op_explode",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
    UNION ALL SELECT event_id, user_id FROM events""",
)
def op_explode(spark, sf_dir):
    replies = F.concat(F.lit("["), "props", F.lit(',{"k": '), F.col("user_id").cast("string"), F.lit("}]"))
    nested = _events(spark, sf_dir).select("event_id", replies.alias("replies"))
    step = Step("explode", ["replies"], "reply", {"schema": "array<struct<k:bigint>>"})
    return R.explode_json(nested, step).select("event_id", F.col("reply.k").alias("k"))


@query(
    "op_melt",
    """SELECT doc_id, 'quality' AS measure, quality AS score FROM labels
    UNION ALL SELECT doc_id, 'toxic', toxic FROM labels""",
)
def op_melt(spark, sf_dir):
    step = Step("melt", ["quality", "toxic"], "score", {"ids": ["doc_id"], "variable": "measure"})
    return R.melt_columns(B.table(spark, sf_dir, "labels"), step)


@query("op_filter", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 50")
def op_filter(spark, sf_dir):
    step = Step("filter", [], params={"predicate": "event_type = 'click' AND value > 50"})
    return R.filter_rows(_events(spark, sf_dir), step).select("event_id", "value")


@query("op_drop_columns", "SELECT doc_id, lang, source FROM documents")
def op_drop_columns(spark, sf_dir):
    return R.drop_columns(B.table(spark, sf_dir, "documents"), Step("drop_columns", ["text", "n_chars"]))


@query(
    "apply_recipe",
    """SELECT CAST(e.event_id AS VARCHAR) AS id, e.event_type || '/' || e.user_id AS tag,
              strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS ts, 'value' AS measure, e.value AS score
    FROM events e WHERE e.value >= 10
    UNION ALL SELECT CAST(event_id AS VARCHAR), event_type || '/' || user_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), 'user',
              CAST(user_id AS DOUBLE) FROM events WHERE value >= 10""",
)
def apply_recipe(spark, sf_dir):
    raw = _events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("d"),
        F.date_format("ts", "HH:mm:ss").alias("t"),
        "event_type",
        "user_id",
        "value",
        F.col("user_id").cast("double").alias("user"),
        "props",
    )
    recipe = [
        Step("filter", [], params={"predicate": "value >= 10"}),
        Step("rename", ["event_id"], "id"),
        Step("concat", ["event_type", "user_id"], "tag", {"sep": "/"}),
        Step("parse_datetime", ["d", "t"], "ts"),
        Step("drop_columns", ["d", "t", "event_type", "user_id", "props"]),
        Step("melt", ["value", "user"], "score", {"variable": "measure"}),
    ]
    return R.apply_recipe(raw, recipe).withColumn("ts", _shown("ts"))
