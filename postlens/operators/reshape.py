"""Raw columns to the canonical post table, and recipes of reshape steps."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from postlens.functions.numbers import to_number
from postlens.schema import DatasetRoles

TS_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-MM-dd HH:mm[XXX]",
    "yyyy-MM-dd'T'HH:mm[XXX]",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd HH:mm",
    "yyyy/MM/dd",
)


def canonical_rename(raw: DataFrame, roles: DatasetRoles) -> DataFrame:
    """Role columns get canonical names, all others stay as they are."""
    return raw.withColumnsRenamed({k: v for k, v in roles.renames().items() if k in raw.columns})


def cast_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.col("id").cast("string")) if "id" in df.columns else df


def parse_timestamp(text: Column, formats=TS_FORMATS) -> Column:
    """First format that fits, then Spark's own cast; what fits none is null."""
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.coalesce(*tries, text.try_cast("timestamp"))


def parse_ts_utc(df: DataFrame, formats=TS_FORMATS) -> DataFrame:
    """ts to a timestamp; text without a zone is read in the session zone, which is UTC."""
    if "ts" not in df.columns:
        return df
    if dict(df.dtypes)["ts"] == "string":
        return df.withColumn("ts", parse_timestamp(F.col("ts"), formats))
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def coerce_engagement(df: DataFrame) -> DataFrame:
    if "engagement" not in df.columns:
        return df
    return df.withColumn("engagement", to_number(F.col("engagement")))


def canonical_posts(raw: DataFrame, roles: DatasetRoles) -> DataFrame:
    return reduce(
        lambda df, step: step(df), (cast_id, parse_ts_utc, coerce_engagement), canonical_rename(raw, roles)
    )


def reshape_summary(canonical: DataFrame, roles: DatasetRoles) -> DataFrame:
    """row_count, column_count, renames_applied, ts_parsed, ts_null_after_parse."""
    renames = {k: v for k, v in roles.renames().items() if v in canonical.columns}
    has_ts = "ts" in canonical.columns
    missing = F.count_if(F.col("ts").isNull()) if has_ts else F.max(F.lit(None).cast("bigint"))
    return canonical.agg(F.count(F.lit(1)).alias("row_count"), missing.alias("ts_null_after_parse")).select(
        "row_count",
        F.lit(len(canonical.columns)).alias("column_count"),
        F.lit(", ".join(f"{k}->{v}" for k, v in renames.items())).alias("renames_applied"),
        F.lit(has_ts).alias("ts_parsed"),
        "ts_null_after_parse",
    )


def parse_fail_gate(canonical: DataFrame, columns=("ts", "engagement"), limit_pct: float = 50.0) -> DataFrame:
    """column, failed_pct, rejected for every parsed column that is present."""
    present = [c for c in columns if c in canonical.columns]
    shares = canonical.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in present])
    return shares.unpivot([], present, "column", "failed").select(
        "column",
        (F.col("failed") * 100).alias("failed_pct"),
        (F.col("failed") * 100 > limit_pct).alias("rejected"),
    )


def enforce_parse_gate(canonical: DataFrame, columns=("ts", "engagement"), limit_pct: float = 50.0) -> DataFrame:
    """The input unchanged, or a failed job when a column is rejected by the gate."""
    gate = parse_fail_gate(canonical, columns, limit_pct)
    rejected = gate.agg(F.coalesce(F.bool_or("rejected"), F.lit(False)).alias("any")).scalar()
    failure = F.raise_error(F.lit(f"more than {limit_pct} % of the rows failed to parse")).cast("boolean")
    return canonical.where(F.when(rejected, failure).otherwise(F.lit(True)))


# --- recipe steps -------------------------------------------------------------


@dataclass(frozen=True)
class ReshapeStep:
    op: str
    source: list[str]
    target: str = ""
    params: dict[str, Any] = field(default_factory=dict)
    rationale: str = ""


def rename_column(df: DataFrame, s: ReshapeStep) -> DataFrame:
    return df.withColumnRenamed(s.source[0], s.target)


def concat_columns(df: DataFrame, s: ReshapeStep) -> DataFrame:
    """Joins the sources with ``sep``; nulls are left out."""
    return df.withColumn(s.target, F.concat_ws(s.params.get("sep", " "), *s.source))


def split_column(df: DataFrame, s: ReshapeStep) -> DataFrame:
    """Parts of a column, by literal separator, into ``targets`` (missing parts are null)."""
    targets = s.params.get("targets") or [s.target]
    parts = F.split(s.source[0], "\\Q" + s.params["sep"] + "\\E", s.params.get("limit", -1))
    return df.withColumns({t: F.get(parts, F.lit(i)) for i, t in enumerate(targets)})


def parse_datetime(df: DataFrame, s: ReshapeStep) -> DataFrame:
    """Date and time columns joined by a space and parsed; misfits are null."""
    joined = F.concat_ws(" ", *s.source)
    formats = [s.params["format"]] if "format" in s.params else TS_FORMATS
    return df.withColumn(s.target, parse_timestamp(joined, formats))


def set_timezone(df: DataFrame, s: ReshapeStep) -> DataFrame:
    """``mode`` attach: the wall clock is in ``zone``; convert: show the UTC instant as wall clock in ``zone``."""
    source, zone = F.col(s.source[0]), F.lit(s.params["zone"])
    if s.params.get("mode", "attach") == "attach":
        return df.withColumn(s.target, F.to_utc_timestamp(source, zone))
    return df.withColumn(s.target, F.from_utc_timestamp(source, zone))


def aggregate_columns(df: DataFrame, s: ReshapeStep) -> DataFrame:
    """Row-wise sum of numeric-looking columns, or with ``by`` a grouped sum."""
    if "by" in s.params:
        return df.groupBy(*s.params["by"]).agg(F.sum(to_number(F.col(s.source[0]))).alias(s.target))
    numbers = [F.coalesce(to_number(F.col(c)), F.lit(0.0)) for c in s.source]
    return df.withColumn(s.target, reduce(lambda a, b: a + b, numbers))


def explode_json(df: DataFrame, s: ReshapeStep) -> DataFrame:
    """A JSON text column of type ``schema`` (an array) to one row per element; none keeps the row."""
    parsed = F.from_json(s.source[0], s.params["schema"])
    return df.withColumn(s.target, F.explode_outer(parsed))


def melt_columns(df: DataFrame, s: ReshapeStep) -> DataFrame:
    """Wide to long: the sources become (``variable``, target) rows."""
    keep = s.params.get("ids") or [c for c in df.columns if c not in s.source]
    return df.unpivot(keep, s.source, s.params.get("variable", "variable"), s.target or "value")


def filter_rows(df: DataFrame, s: ReshapeStep) -> DataFrame:
    return df.where(s.params["predicate"])


def drop_columns(df: DataFrame, s: ReshapeStep) -> DataFrame:
    return df.drop(*s.source)


STEPS = {
    "rename": rename_column,
    "concat": concat_columns,
    "split": split_column,
    "parse_datetime": parse_datetime,
    "set_timezone": set_timezone,
    "aggregate": aggregate_columns,
    "explode": explode_json,
    "melt": melt_columns,
    "filter": filter_rows,
    "drop_columns": drop_columns,
}


def is_trivial(recipe: list[ReshapeStep]) -> bool:
    return all(step.op == "rename" for step in recipe)


def apply_recipe(df: DataFrame, recipe: list[ReshapeStep]) -> DataFrame:
    """The steps in order, as one lazy plan."""
    return reduce(lambda current, step: STEPS[step.op](current, step), recipe, df)
