"""Stage tables, JSON and text outputs, content fingerprints, the audit log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

AUDIT_SCHEMA = (
    "timestamp timestamp, stage string, action string, affected_rows bigint, reason string, "
    "artifact_path string, artifact_hash string"
)


def fingerprint(df: DataFrame) -> DataFrame:
    """n_rows, xor_hash, sum_hash: the same for the same rows in any order or file layout."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(*_fingerprint_columns(row))


def _fingerprint_columns(row):
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.bit_xor(row), F.lit(0)).alias("xor_hash"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("sum_hash"),
    ]


@dataclass(frozen=True)
class StageResult:
    df: DataFrame
    path: str
    n_rows: int
    digest: str


def write_stage(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> StageResult:
    """Writes parquet once; row count and fingerprint are observed during that write."""
    seen = Observation()
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    first, *others = _fingerprint_columns(row)
    df.observe(seen, first, *others).write.partitionBy(*partition_by).parquet(path)
    found = seen.get
    digest = f"{found['n_rows']}:{found['xor_hash']}:{found['sum_hash']}"
    return StageResult(df.sparkSession.read.parquet(path), path, found["n_rows"], digest)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Report lines (a few hundred at most) as one text file in order."""
    lines.orderBy("section", "ord", "sub").coalesce(1).select("line").write.text(path)


def audit_entry(
    spark: SparkSession,
    stage: str,
    action: str,
    affected_rows: int | None,
    reason: str,
    artifact_path: str | None = None,
    artifact_hash: str | None = None,
) -> DataFrame:
    row = [(stage, action, affected_rows, reason, artifact_path, artifact_hash)]
    names = "stage string, action string, affected_rows bigint, reason string, artifact_path string, artifact_hash string"
    return spark.createDataFrame(row, names).select(F.current_timestamp().alias("timestamp"), "*")


def audit_append(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def audit_tail(log: DataFrame, n: int = 10) -> DataFrame:
    """The latest entries, newest first."""
    return log.orderBy(F.desc("timestamp"), F.desc("stage"), F.desc("action")).limit(n)
