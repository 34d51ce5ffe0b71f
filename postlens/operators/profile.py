"""Column profiles of an all-string table and the roles inferred from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from postlens.functions.numbers import percent, round_half_even
from postlens.functions.text import is_valid_text
from postlens.seeds import patterns as P
from postlens.seeds.words import AUTHOR_HINTS, PLATFORM_HINTS
from postlens.session import stored

SAMPLES = 5
SAMPLE_CHARS = 120
SKETCH_BITS = 16
MERGE_GROUPS = 64
COLUMNS_A_PASS = 16


def profile_columns(raw: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per column: ordinal, name, dtype, null_pct, unique_pct, sample_values.

    Two aggregates over the table as it is, without a row per cell. The first
    keeps for each column its filled cells, a theta sketch of its values and
    the smallest value of each of a few hash buckets. The sketch counts up to
    2^SKETCH_BITS distinct values exactly; beyond, the standard error is 0.4 %
    of the count. The smallest values bound the ``samples`` smallest ones from
    above, and the second aggregate collects the values up to that bound, which
    are about as many. Samples are the smallest distinct non-blank values, cut
    to 120 characters. Wide tables are read some columns at a time.

    Defined results: a column without values has no samples and a unique_pct of
    0; in an empty table every null_pct is 100; names may hold dots and blanks.
    """
    names = list(enumerate(raw.columns))
    blocks = [names[at : at + COLUMNS_A_PASS] for at in range(0, len(names), COLUMNS_A_PASS)]
    return reduce(DataFrame.unionByName, [_profile_block(raw, block, samples) for block in blocks])


def _profile_block(raw: DataFrame, block: list[tuple[int, str]], samples: int) -> DataFrame:
    dtypes = dict(raw.dtypes)
    at = [i for i, _ in block]
    values = raw.select(*[F.col("`" + c.replace("`", "``") + "`").cast("string").alias(f"v{i}") for i, c in block])
    hashed = values.select("*", *[F.when(F.col(f"v{i}").isNotNull(), F.xxhash64(f"v{i}")).alias(f"h{i}") for i in at])
    # Texts that begin alike are told apart by their hashes.
    entry = {i: F.struct(F.substring(f"v{i}", 1, SAMPLE_CHARS).alias("text"), F.col(f"h{i}").alias("hash")) for i in at}
    cells = hashed.select(
        *[f"h{i}" for i in at], *[F.when(is_valid_text(F.col(f"v{i}")), entry[i]).alias(f"s{i}") for i in at]
    )
    stats = stored(_sketches(cells, at, samples + 3, samples), "profile")
    found = stats.select(F.struct("*").alias("row")).scalar()

    def bounded(i: int) -> Column:
        bound = found[f"bound{i}"]
        return F.collect_set(F.when(bound.isNull() | (F.col(f"s{i}") <= bound), F.col(f"s{i}"))).alias(f"s{i}")

    n_rows = F.greatest(found["n"], F.lit(1))
    profile = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(c).alias("name"),
            F.lit(dtypes[c]).alias("dtype"),
            round_half_even((1 - found[f"filled{i}"] / n_rows) * 100, 2).alias("null_pct"),
            percent(found[f"unique{i}"], n_rows).alias("unique_pct"),
            F.slice(F.array_sort(f"s{i}"), 1, samples)["text"].alias("sample_values"),
        )
        for i, c in block
    ]
    return cells.agg(*[bounded(i) for i in at]).select(F.inline(F.array(*profile)))


def _sketches(cells: DataFrame, at: list[int], buckets: int, samples: int) -> DataFrame:
    """One row: n and, for each column, filled, unique and the bound of its smallest values (null: few values)."""
    slots = [(i, b) for i in at for b in range(buckets)]
    # Tasks meet in a few groups first, so that no task merges the sketches of all.
    parts = cells.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("part")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(f"s{i}").alias(f"filled{i}") for i in at],
        *[F.count(f"h{i}").alias(f"given{i}") for i in at],
        *[F.theta_sketch_agg(f"h{i}", SKETCH_BITS).alias(f"sketch{i}") for i in at],
        *[F.expr(f"min(if(pmod(h{i}, {buckets}) = {b}, s{i}, null)) AS least{i}_{b}") for i, b in slots],
    )
    whole = parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        *[F.coalesce(F.sum(f"filled{i}"), F.lit(0)).alias(f"filled{i}") for i in at],
        *[F.coalesce(F.sum(f"given{i}"), F.lit(0)).alias(f"given{i}") for i in at],
        *[F.theta_union_agg(f"sketch{i}", SKETCH_BITS).alias(f"sketch{i}") for i in at],
        *[F.expr(f"min(least{i}_{b}) AS least{i}_{b}") for i, b in slots],
    )

    def bound(i: int) -> Column:
        least = F.array_compact(F.array(*[F.col(f"least{i}_{b}") for b in range(buckets)]))
        return F.get(F.array_sort(least), F.lit(samples - 1)).alias(f"bound{i}")

    def unique(i: int) -> Column:
        seen = F.coalesce(F.theta_sketch_estimate(f"sketch{i}"), F.lit(0).cast("bigint"))
        return F.least(seen, F.col(f"given{i}")).alias(f"unique{i}")

    return whole.select("n", *[F.col(f"filled{i}") for i in at], *map(unique, at), *map(bound, at))


def ingest_summary(raw: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """row_count, column_count and, with a binaryFile frame, file_size_bytes."""
    out = raw.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(raw.columns)))
    if files is not None:
        out = out.withColumn("file_size_bytes", files.agg(F.sum("length").alias("bytes")).scalar())
    return out


def _matches(pattern: str) -> Column:
    """At least max(1, half) of the samples fit the pattern."""
    hits = F.size(F.filter("sample_values", lambda s: F.trim(s).rlike(pattern)))
    return hits >= F.greatest(F.lit(1), F.floor(F.size("sample_values") / 2))


def shape_tests(profiles: DataFrame) -> DataFrame:
    """Adds looks_datetime, looks_numeric and avg_sample_len."""
    lengths = F.transform("sample_values", lambda s: F.length(s))
    total = F.aggregate(lengths, F.lit(0), lambda a, n: a + n)
    return profiles.withColumns(
        {
            "looks_datetime": _matches(P.DATETIME_LIKE),
            "looks_numeric": _matches(P.NUMERIC_LIKE),
            "avg_sample_len": F.coalesce(F.try_divide(total, F.size("sample_values")), F.lit(0.0)),
        }
    )


def infer_roles(profiles: DataFrame) -> DataFrame:
    """One row: id_col, text_col, timestamp_col, engagement_col, platform_col, author_col.

    The profile table has one row per column, so it is folded into one array
    and ranked role by role there; ties go to the column that comes first.
    """
    lowered = F.lower("name")

    def hinted(hints: list[str]) -> Column:
        return lowered.rlike("|".join(f"\\Q{h}\\E" for h in hints))

    entry = F.struct(
        "ordinal",
        "name",
        "unique_pct",
        "avg_sample_len",
        "looks_datetime",
        "looks_numeric",
        (~F.col("looks_datetime") & ~F.col("looks_numeric")).alias("plain"),
        hinted(PLATFORM_HINTS).alias("platform_hint"),
        hinted(AUTHOR_HINTS).alias("author_hint"),
    )
    columns = shape_tests(profiles).agg(F.array_sort(F.collect_list(entry)).alias("entries"))

    def first(condition, array: str = "entries") -> Column:
        return F.get(F.filter(array, condition), F.lit(0))["name"]

    def highest(field: str, condition) -> Column:
        keyed = F.transform(
            F.filter("entries", condition), lambda e: F.struct((-e[field]).alias("key"), e["ordinal"], e["name"])
        )
        return F.array_min(keyed)["name"]

    def other_than(entry_: Column, *names: str) -> Column:
        clear = [~F.coalesce(entry_["name"] == F.col(n), F.lit(False)) for n in names]
        return reduce(lambda a, b: a & b, clear)

    best_id = F.coalesce(
        highest("unique_pct", lambda e: e["plain"] & (e["unique_pct"] > 80)),
        highest("unique_pct", lambda e: F.lit(True)),
    )
    longest = highest("avg_sample_len", lambda e: e["plain"] & other_than(e, "id_col"))
    enums = F.filter(
        "entries",
        lambda e: (e["unique_pct"] <= 5)
        & ~e["looks_numeric"]
        & other_than(e, "id_col", "text_col", "timestamp_col", "engagement_col"),
    )
    rest = F.filter("enums", lambda e: other_than(e, "named_platform", "named_author"))
    # The first free column stands in for a missing platform, the next free one for a missing author.
    place = F.when(F.col("named_platform").isNull(), 1).otherwise(0)
    return (
        columns.withColumn("id_col", best_id)
        .withColumn("text_col", F.coalesce(longest, "id_col"))
        .withColumn("timestamp_col", first(lambda e: e["looks_datetime"]))
        .withColumn("engagement_col", first(lambda e: e["looks_numeric"] & other_than(e, "id_col")))
        .withColumn("enums", enums)
        .withColumn("named_platform", first(lambda e: e["platform_hint"], "enums"))
        .withColumn("named_author", first(lambda e: e["author_hint"] & other_than(e, "named_platform"), "enums"))
        .withColumn("rest", rest)
        .select(
            "id_col",
            "text_col",
            "timestamp_col",
            "engagement_col",
            F.coalesce("named_platform", F.get("rest", F.lit(0))["name"]).alias("platform_col"),
            F.coalesce("named_author", F.get("rest", place)["name"]).alias("author_col"),
        )
    )


def require_text(profiles: DataFrame) -> DataFrame:
    """Fails the job when no column can hold text; otherwise the profiles unchanged."""
    shaped = shape_tests(profiles)
    n_text = shaped.agg(F.count_if(~F.col("looks_datetime") & ~F.col("looks_numeric")).alias("n")).scalar()
    return profiles.where(
        F.when(n_text > 0, F.lit(True)).otherwise(F.raise_error(F.lit("no_text_column")).cast("boolean"))
    )


def infer_language(profiles: DataFrame, text_col: Column) -> DataFrame:
    """language: zh-TW or zh when the samples of the text column hold CJK, else en."""
    joined = F.array_join("sample_values", " ")
    zh = F.when(joined.rlike(P.TRADITIONAL_IN_SAMPLES), "zh-TW").otherwise("zh")
    return profiles.where(F.col("name") == text_col).select(
        F.when(joined.rlike(P.CJK_IN_SAMPLES), zh).otherwise("en").alias("language")
    )
