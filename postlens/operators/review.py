"""Human decisions as tables: questions, answers, threshold alarms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from postlens.functions.numbers import one_row
from postlens.operators.sentiment import DISAGREEMENT_PCT
from postlens.schema import Thresholds

QUESTION_COLUMNS = [
    "question_id",
    "stage",
    "question_type",
    "prompt",
    "payload",
    "proposal",
    "why_asking",
    "blocks_stage",
]


def _question(
    frame: DataFrame, key: str, stage: str, kind: str, prompt: Column, payload: Column, proposal: Column, why: Column,
    blocks: bool,
) -> DataFrame:
    return frame.select(
        F.lit(key).alias("question_id"),
        F.lit(stage).alias("stage"),
        F.lit(kind).alias("question_type"),
        prompt.alias("prompt"),
        payload.alias("payload"),
        proposal.alias("proposal"),
        why.alias("why_asking"),
        F.lit(blocks).alias("blocks_stage"),
    )


def schema_question(roles: DataFrame, run_id: str = "run") -> DataFrame:
    """Always asked: the proposed column roles."""
    proposed = F.to_json(F.struct(*roles.columns))
    return _question(
        roles,
        f"schema-{run_id}",
        "schema_infer",
        "confirm",
        F.lit(
            "These roles were read from the columns. Approve them, or name the right column for each role."
        ),
        proposed,
        proposed,
        F.lit("roles are a guess from names and values"),
        True,
    )


def skew_question(skewed: DataFrame, run_id: str = "run") -> DataFrame:
    """Asked when eda_skew_rule gives a row."""
    return _question(
        skewed,
        f"eda-skew-{run_id}",
        "eda",
        "open",
        F.format_string("%s alone accounts for %.0f%% of the posts. Is that expected?", F.col("platform"), F.col("pct")),
        F.to_json(F.struct("platform", "n", "pct")),
        F.lit(None).cast("string"),
        F.format_string("one platform, %s, holds over 60%% of the posts", F.col("platform")),
        False,
    )


def calibration_question(
    summary: DataFrame, sample: DataFrame, threshold_pct: float = DISAGREEMENT_PCT, run_id: str = "run"
) -> DataFrame:
    """Asked when more than ``threshold_pct`` of the posts are disputed; the payload is the sample (10 rows)."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("engagement")).alias("o"), "id", "final_label")))
    items = F.transform(rows, lambda r: F.struct(r["id"].alias("id"), r["final_label"].alias("label")))
    payload = sample.agg(F.to_json(items).alias("items")).scalar()
    pct = F.col("disagreement_pct").cast("string")
    return _question(
        summary.where(F.col("disagreement_pct") > threshold_pct),
        f"sentiment-calibrate-{run_id}",
        "sentiment",
        "calibrate",
        F.format_string(
            f"Rules and word list differ on %s%% of the posts, above {threshold_pct}%%. Which label fits these samples?", pct
        ),
        payload,
        payload,
        F.format_string(f"labels differ on %s%% of the posts, limit {threshold_pct}%%", pct),
        False,
    )


def topic_question(summary: DataFrame, labels: DataFrame, run_id: str = "run") -> DataFrame:
    """Asked whenever topics were found; the payload holds one draft label per topic."""
    drafts = F.array_sort(F.collect_list(F.struct("topic_id", "auto_label")))
    payload = labels.agg(F.to_json(drafts).alias("labels")).scalar()
    return _question(
        summary.where(F.col("topic_count") > 0),
        f"topic-label-{run_id}",
        "topic",
        "label",
        F.format_string("%d topics have draft names only. Give each a name of your own.", F.col("topic_count")),
        payload,
        payload,
        F.format_string("%d topics without a name", F.col("topic_count")),
        True,
    )


def review_queue(*questions: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, questions).select(*QUESTION_COLUMNS)


def pending_questions(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions without any answer, approved or not."""
    return queue.join(answers.select("question_id"), "question_id", "left_anti")


def applied_answers(answers: DataFrame) -> DataFrame:
    """question_id, response of the latest approved answer. answers: question_id, response, approved, timestamp."""
    return (
        answers.where(F.col("approved"))
        .groupBy("question_id")
        .agg(F.max_by("response", F.struct("timestamp", "response")).alias("response"))
    )


def schema_answer(answers: DataFrame, fields: list[str]) -> DataFrame:
    """One column a field: what the latest approved answers say, as JSON ``{"schema": {...}}`` or the fields alone."""
    shape = ", ".join(f"{f}: string" for f in fields)
    parsed = F.from_json("response", f"struct<schema: struct<{shape}>, {shape}>")
    replies = applied_answers(answers).select(parsed.alias("given"))
    return replies.select(*[F.coalesce(F.col(f"given.schema.{f}"), F.col(f"given.{f}")).alias(f) for f in fields])


def topic_label_answers(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """topic_id, label from the latest approved answers to topic questions: ``{"labels": {id: label}}`` or the map alone."""
    asked = queue.where((F.col("stage") == "topic") & (F.col("question_type") == "label")).select("question_id")
    replies = applied_answers(answers).join(asked, "question_id", "left_semi")
    nested = F.from_json("response", "struct<labels: map<string,string>>")["labels"]
    parsed = F.coalesce(nested, F.from_json("response", "map<string,string>"))
    return replies.select(F.explode(parsed).alias("topic", "label")).select(
        F.col("topic").try_cast("int").alias("topic_id"), "label"
    )


def threshold_table(frame: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """metric, threshold: one row per configured limit."""
    rows = [(name, float(value)) for name, value in vars(thresholds).items()]
    return frame.sparkSession.createDataFrame(rows, "metric string, threshold double")


def metrics(frame: DataFrame, **values: Column) -> DataFrame:
    """metric, value: scalar columns turned long."""
    return one_row(frame, **{k: v.cast("double") for k, v in values.items()}).unpivot(
        [], list(values), "metric", "value"
    )


def threshold_alarms(measured: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """metric, value, threshold, alarm for every measured metric that has a limit."""
    # The threshold table has five rows.
    limits = F.broadcast(threshold_table(measured, thresholds))
    return measured.join(limits, "metric").withColumn(
        "alarm", F.coalesce(F.col("value") > F.col("threshold"), F.lit(False))
    )
