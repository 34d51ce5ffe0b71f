"""Sources, sinks, profiling and roles over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import eda, profile
from postlens.plans import bind as B
from postlens.plans.catalog import cte, query
from postlens.seeds.words import NA_TOKENS
from postlens.session import scratch_path
from postlens.sources import readers, sinks

DOCUMENT_TEXT_SQL = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents"


def _documents(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@query("src_csv", DOCUMENT_TEXT_SQL)
def src_csv(spark, sf_dir):
    path = scratch_path(spark, "csv") + ".csv"
    writer = _documents(spark, sf_dir).write.option("header", True).option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.load_dataset(spark, path)


@query("src_json", DOCUMENT_TEXT_SQL)
def src_json(spark, sf_dir):
    path = scratch_path(spark, "json") + ".json"
    records = F.collect_list(F.struct("doc_id", "text", "lang", "source"))
    arrays = _documents(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 500)).agg(F.to_json(records).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)  # a file for each array
    return readers.load_dataset(spark, path)


@query("src_jsonl", DOCUMENT_TEXT_SQL)
def src_jsonl(spark, sf_dir):
    path = scratch_path(spark, "jsonl") + ".jsonl"
    _documents(spark, sf_dir).write.json(path)
    return readers.load_dataset(spark, path).select("doc_id", "text", "lang", "source")


@query(
    "src_parquet",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents",
)
def src_parquet(spark, sf_dir):
    return readers.load_dataset(spark, f"{sf_dir}/documents.parquet")


@query(
    "src_all_string",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text,
              '{"conv_id":' || conv_id || ',"turn":' || turn || '}' AS key FROM conversations""",
)
def src_all_string(spark, sf_dir):
    chats = B.table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return readers.all_string(chats)


@query(
    "src_na_tokens",
    f"""SELECT doc_id, lang, CASE WHEN source IN ({", ".join(f"'src{i}'" for i in range(len(NA_TOKENS)))}) THEN NULL
        ELSE source END AS source FROM documents""",
)
def src_na_tokens(spark, sf_dir):
    """The first sources carry one of the shipped tokens each."""
    marked = F.col("source")
    for i, token in enumerate(NA_TOKENS):
        marked = F.when(F.col("source") == f"src{i}", token).otherwise(marked)
    documents = B.table(spark, sf_dir, "documents").select("doc_id", "lang", marked.alias("source"))
    return readers.na_tokens_to_null(documents)


@query("file_digest")
def file_digest(spark, sf_dir):
    return readers.file_digest(spark, f"{sf_dir}/documents.parquet").select("length", "sha256")


@query("stage_sink", "SELECT count(*) AS n_rows, true AS same_content FROM posts")
def stage_sink(spark, sf_dir):
    # The fingerprint takes a row's columns in order, and a partition column is read back as the last one.
    columns = ["id", "text", "ts", "author", "engagement", "platform", "lang"]
    result = sinks.write_stage(B.posts(spark, sf_dir).select(*columns), scratch_path(spark, "stage"), ("platform",))
    again = sinks.fingerprint(result.df.select(*columns))
    digest = F.concat_ws(":", F.col("n_rows"), F.col("xor_hash"), F.col("sum_hash"))
    return again.select("n_rows", (digest == result.digest).alias("same_content"))


@query("sink_json", "SELECT id, author, platform, lang, engagement FROM posts")
def sink_json(spark, sf_dir):
    path = scratch_path(spark, "json")
    sinks.write_json(B.posts(spark, sf_dir).select("id", "author", "platform", "lang", "engagement"), path)
    return spark.read.schema("id string, author string, platform string, lang string, engagement double").json(path)


@query(
    "audit_append",
    """SELECT 'ingest' AS stage, 'loaded raw table' AS action, count(*) AS affected_rows FROM documents
    UNION ALL SELECT 'eda', 'counted distinct authors', count(DISTINCT event_type) FROM events""",
)
def audit_append(spark, sf_dir):
    log = scratch_path(spark, "audit")
    loaded = sinks.write_stage(B.table(spark, sf_dir, "documents"), scratch_path(spark, "stage"))
    sinks.audit_append(
        sinks.audit_entry(spark, "ingest", "loaded raw table", loaded.n_rows, "first stage", loaded.path, loaded.digest),
        log,
    )
    authors = eda.category_counts(B.posts(spark, sf_dir).select("author"), "author").count()
    sinks.audit_append(sinks.audit_entry(spark, "eda", "counted distinct authors", authors, "profile"), log)
    return spark.read.schema(sinks.AUDIT_SCHEMA).parquet(log).select("stage", "action", "affected_rows")


@query(
    "audit_tail",
    """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, event_type AS stage, props AS action FROM events
    ORDER BY ts DESC, event_type DESC, props DESC LIMIT 10""",
)
def audit_tail(spark, sf_dir):
    log = B.table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("stage"), F.col("props").alias("action")
    )
    shown = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    return sinks.audit_tail(log).select(shown, "stage", "action")


# --- profile ------------------------------------------------------------------


def _cells_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS name, {c} AS value FROM raw_table" for i, c in enumerate(B.RAW_COLUMNS)
    )


cte("cells", _cells_sql())
cte(
    "column_stats",
    f"""SELECT ordinal, name, {B.half_even("(1 - count(*) FILTER (WHERE regexp_matches(value, '[^" + B.SQL_SPACE + "]')) / (SELECT count(*) FROM raw_table)) * 100", 2)} AS null_pct,
        {B.pct("count(DISTINCT value)", "(SELECT count(*) FROM raw_table)")} AS unique_pct
    FROM cells GROUP BY ordinal, name""",
)
cte(
    "column_samples",
    f"""SELECT ordinal, list(sample ORDER BY sample) AS samples FROM (
        SELECT ordinal, left(value, 120) AS sample,
               row_number() OVER (PARTITION BY ordinal ORDER BY left(value, 120), sha256(value)) AS place
        FROM (SELECT DISTINCT ordinal, value FROM cells WHERE regexp_matches(value, '[^{B.SQL_SPACE}]')))
    WHERE place <= 5 GROUP BY ordinal""",
)
cte(
    "shapes",
    """SELECT *, len(list_filter(samples, lambda s: regexp_matches(trim(s), '^\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}([ T]\\d{1,2}:\\d{2})?')))
            >= greatest(1, len(samples) // 2) AS looks_datetime,
        len(list_filter(samples, lambda s: regexp_matches(trim(s), '^-?\\d+(\\.\\d+)?$')))
            >= greatest(1, len(samples) // 2) AS looks_numeric,
        list_sum(list_transform(samples, lambda s: length(s)))::DOUBLE / len(samples) AS avg_sample_len
    FROM column_stats JOIN column_samples USING (ordinal)""",
)


def _profiles(spark, sf_dir):
    return profile.profile_columns(B.raw_table(spark, sf_dir))


@query(
    "profile_columns",
    """SELECT CAST(ordinal AS INTEGER) AS ordinal, name, 'string' AS dtype, null_pct, unique_pct,
              array_to_string(samples, '|') AS samples
    FROM column_stats JOIN column_samples USING (ordinal)""",
)
def profile_columns(spark, sf_dir):
    return _profiles(spark, sf_dir).select(
        "ordinal", "name", "dtype", "null_pct", "unique_pct", F.array_join("sample_values", "|").alias("samples")
    )


@query("ingest_summary", "SELECT count(*) AS row_count, CAST(7 AS INTEGER) AS column_count FROM raw_table")
def ingest_summary(spark, sf_dir):
    return profile.ingest_summary(B.raw_table(spark, sf_dir))


@query("shape_tests", "SELECT name, looks_datetime, looks_numeric, avg_sample_len FROM shapes")
def shape_tests(spark, sf_dir):
    return profile.shape_tests(_profiles(spark, sf_dir)).select(
        "name", "looks_datetime", "looks_numeric", "avg_sample_len"
    )


@query(
    "infer_roles",
    """SELECT *, (SELECT name FROM shapes WHERE unique_pct <= 5 AND NOT looks_numeric
                    AND name NOT IN (id_col, text_col, timestamp_col, engagement_col)
                    AND regexp_matches(lower(name), 'platform|source|平台|channel') ORDER BY ordinal LIMIT 1) AS platform_col,
                 (SELECT name FROM shapes WHERE unique_pct <= 5 AND NOT looks_numeric
                    AND name NOT IN (id_col, text_col, timestamp_col, engagement_col)
                    AND NOT regexp_matches(lower(name), 'platform|source|平台|channel')
                    AND regexp_matches(lower(name), 'author|user|帳號|type|role') ORDER BY ordinal LIMIT 1) AS author_col
    FROM (SELECT *, (SELECT name FROM shapes WHERE NOT looks_datetime AND NOT looks_numeric AND name <> id_col
                     ORDER BY avg_sample_len DESC, ordinal LIMIT 1) AS text_col,
                 (SELECT name FROM shapes WHERE looks_datetime ORDER BY ordinal LIMIT 1) AS timestamp_col,
                 (SELECT name FROM shapes WHERE looks_numeric AND name <> id_col ORDER BY ordinal LIMIT 1) AS engagement_col
          FROM (SELECT name AS id_col FROM shapes WHERE NOT looks_datetime AND NOT looks_numeric AND unique_pct > 80
                ORDER BY unique_pct DESC, ordinal LIMIT 1))""",
)
def infer_roles(spark, sf_dir):
    return profile.infer_roles(_profiles(spark, sf_dir))


@query(
    "infer_language",
    """SELECT CASE WHEN NOT regexp_matches(array_to_string(samples, ' '), '[㐀-鿿]') THEN 'en'
                   WHEN regexp_matches(array_to_string(samples, ' '), '[颱這個們麼說發點時間實國灣]') THEN 'zh-TW'
                   ELSE 'zh' END AS language
    FROM shapes WHERE name = 'body'""",
)
def infer_language(spark, sf_dir):
    return profile.infer_language(_profiles(spark, sf_dir), F.lit("body"))
