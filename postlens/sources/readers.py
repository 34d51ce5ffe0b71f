"""Files to all-string tables, chosen by suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from postlens.seeds.words import NA_TOKENS
from postlens.sources.records import Brackets, Quotes, chunk_effects, sha256_of, split_csv, split_json


def all_string(df: DataFrame) -> DataFrame:
    """Every column as text; nested values as JSON. Nulls stay null."""

    def as_text(field):
        column = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, (ArrayType, MapType, StructType))
        return (F.to_json(column) if nested else column.cast("string")).alias(field.name)

    return df.select(*[as_text(f) for f in df.schema.fields])


def na_tokens_to_null(df: DataFrame, tokens=tuple(NA_TOKENS)) -> DataFrame:
    """Text that stands for a missing value becomes null, in string columns."""
    texts = {name for name, kind in df.dtypes if kind == "string"}

    def cleaned(name):
        column = F.col(f"`{name}`")
        return (F.when(~column.isin(list(tokens)), column) if name in texts else column).alias(name)

    return df.select(*[cleaned(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, multiline: bool = False) -> DataFrame:
    """CSV with a header; RFC 4180 quotes. Missing-value tokens become null.

    Files are split over tasks. One pass over the raw lines finds each file's
    encoding (UTF-8, cp950 or Big5) and whether quotes hold line breaks. Plain
    UTF-8 files go to Spark's reader; else records are cut and decoded file by
    file (see ``records``). With ``encoding`` (and ``multiline``, which reads
    each file in one task) Spark's reader is told what to do instead.
    """
    if encoding is None and not multiline:
        effects = chunk_effects(spark, path, Quotes())
        plain = effects.agg(F.coalesce(F.bool_or(F.col("odd") | F.col("bad_0")), F.lit(False)).alias("no")).first()
        if plain["no"]:
            return na_tokens_to_null(split_csv(spark, path, effects))
    raw = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("encoding", encoding or "UTF-8")
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return na_tokens_to_null(raw)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON array of records, split over tasks; files of another shape are read by a task each."""
    effects = chunk_effects(spark, path, Brackets())
    other = effects.where((F.col("at") == 0) & (F.col("lead") != "["))
    if other.isEmpty() and not effects.isEmpty():
        return all_string(split_json(spark, path, effects))
    return all_string(spark.read.option("multiLine", True).option("primitivesAsString", True).json(path))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per line; files are split."""
    return all_string(spark.read.option("primitivesAsString", True).json(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return all_string(spark.read.parquet(path))


READERS = {".csv": read_csv, ".json": read_json, ".jsonl": read_jsonl, ".parquet": read_parquet}


def load_dataset(spark: SparkSession, path: str, **options) -> DataFrame:
    """The reader for the path's suffix, with its options; an unknown suffix is an error."""
    lowered = path.lower().rstrip("/")
    for suffix, reader in READERS.items():
        if lowered.endswith(suffix):
            return reader(spark, path, **options)
    raise ValueError(f"unsupported file type: {path}")


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of each raw file, read in small blocks."""
    return sha256_of(spark, path)
