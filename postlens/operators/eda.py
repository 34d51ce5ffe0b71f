"""Exploratory statistics and chart data over the canonical post table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlens.session import stored
from postlens.functions.numbers import percent, round_half_even, to_number, total
from postlens.functions.quantiles import quantiles, top_share
from postlens.functions.text import is_valid_text
from postlens.seeds.words import CHART_BOT_LABELS

SIX_HOURS = "6 hours"


def _with_number(posts: DataFrame) -> DataFrame:
    return posts.withColumn("engagement", to_number(F.col("engagement"))).where(F.col("engagement").isNotNull())


# --- time -------------------------------------------------------------------


def volume_6h(posts: DataFrame) -> DataFrame:
    """bin_start, n_posts per 6-hour bin from the first to the last post, empty bins as 0."""
    filled = (
        posts.where(F.col("ts").isNotNull())
        .groupBy(F.window("ts", SIX_HOURS).start.alias("bin_start"))
        .agg(F.count("id").alias("n_posts"))
    )
    filled = stored(filled, "volume-bins")
    low, high = filled.agg(F.min("bin_start"), F.max("bin_start")).first()  # one row
    kind = filled.schema["bin_start"].dataType
    count = 0 if low is None else int((high - low).total_seconds() // 21600) + 1
    # The numbers of the bins are made in parallel, however far apart the first and the last one are.
    numbers = posts.sparkSession.range(count)
    start = F.lit(low).cast(kind) + F.make_dt_interval(F.lit(0), F.col("id").cast("int") * 6)
    bins = numbers.select(start.cast(kind).alias("bin_start"))
    return bins.join(filled, "bin_start", "left").select(
        "bin_start", F.coalesce("n_posts", F.lit(0)).alias("n_posts")
    )


def temporal_summary(posts: DataFrame) -> DataFrame:
    """start, end, duration_days, the earliest busiest 6-hour window and its count."""
    # Empty bins never win, so the filled ones are enough here.
    per_bin = (
        posts.where(F.col("ts").isNotNull())
        .groupBy(F.window("ts", SIX_HOURS).start.alias("bin_start"))
        .agg(F.count("id").alias("n_posts"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    )
    earliest_peak = F.min_by("bin_start", F.struct(-F.col("n_posts"), F.col("bin_start")))
    seconds = F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    return per_bin.agg(
        F.min("lo").alias("start"),
        F.max("hi").alias("end"),
        earliest_peak.alias("peak_6h_window"),
        F.coalesce(F.max("n_posts"), F.lit(0)).alias("peak_6h_count"),
    ).withColumn("duration_days", round_half_even(seconds / F.lit(86400000000.0), 2))


# --- categories ---------------------------------------------------------------


def category_counts(posts: DataFrame, column: str) -> DataFrame:
    return posts.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def categorical_summary(posts: DataFrame, column: str, top: int = 10) -> DataFrame:
    """value, n, pct of the most frequent values, with n_unique."""
    counts = category_counts(posts, column)
    return (
        counts.orderBy(F.desc("n"), F.asc(column))
        .limit(top)
        .select(
            F.col(column).alias("value"),
            "n",
            percent(F.col("n"), total(counts, F.sum("n"))).alias("pct"),
            total(counts, F.count(F.lit(1))).alias("n_unique"),
        )
    )


def chart_categories(posts: DataFrame) -> DataFrame:
    """field, value, n, is_bot: platforms without nulls, authors with the null bar."""
    parts = []
    if "platform" in posts.columns:
        parts.append(
            category_counts(posts, "platform").select(
                F.lit("platform").alias("field"), F.col("platform").alias("value"), "n", F.lit(False).alias("is_bot")
            )
        )
    if "author" in posts.columns:
        authors = posts.groupBy("author").agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            authors.select(
                F.lit("author").alias("field"),
                F.col("author").alias("value"),
                "n",
                F.coalesce(F.col("author").isin(CHART_BOT_LABELS), F.lit(False)).alias("is_bot"),
            )
        )
    if not parts:
        raise ValueError("neither platform nor author column")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def eda_skew_rule(posts: DataFrame, threshold_pct: float = 60.0, platform_notes: bool = False) -> DataFrame:
    """A row when one platform is above the threshold and nothing is noted about platforms yet."""
    top = categorical_summary(posts, "platform", 1)
    return top.where((F.col("pct") > threshold_pct) & F.lit(not platform_notes)).select(
        F.col("value").alias("platform"), "n", "pct"
    )


# --- engagement ---------------------------------------------------------------


def engagement_summary(posts: DataFrame) -> DataFrame:
    """count, median, mean, max, p99, zero_count, top5_share_pct."""
    numbers = _with_number(posts)
    tails = quantiles(numbers, "engagement", {"median": 0.5, "p99": 0.99})
    share = top5_share(posts)
    return numbers.agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("engagement").alias("mean"),
        F.max("engagement").alias("max"),
        F.count_if(F.col("engagement") == 0).alias("zero_count"),
    ).select(
        "count",
        tails.select("median").scalar().alias("median"),
        "mean",
        "max",
        tails.select("p99").scalar().alias("p99"),
        "zero_count",
        share.select("top5_share_pct").scalar().alias("top5_share_pct"),
    )


def top5_share(posts: DataFrame) -> DataFrame:
    """n, k = max(1, int(0.05 n)) and the share of the k largest values in percent."""
    return top_share(_with_number(posts), "engagement", 0.05).select(
        "n", "k", percent(F.col("top_sum"), F.col("total_sum")).alias("top5_share_pct")
    )


def _bin_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """1..bins over [lo, hi]; the maximum belongs to the last bin, one distinct value to the middle."""
    spot = F.width_bucket(value, lo, hi, F.lit(bins))
    return F.when(lo == hi, F.lit(bins // 2 + 1)).otherwise(F.least(spot, F.lit(bins))).cast("int")


def chart_engagement_hist(posts: DataFrame, bins: int = 50) -> DataFrame:
    """bin, bin_lo, bin_hi, n with every bin present."""
    numbers = _with_number(posts)
    lo, hi = total(numbers, F.min("engagement")), total(numbers, F.max("engagement"))
    counts = (
        numbers.select("engagement", lo.alias("lo"), hi.alias("hi"))
        .groupBy(_bin_of(F.col("engagement"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every_bin = posts.sparkSession.range(1, bins + 1).select(
        F.col("id").cast("int").alias("bin"), lo.alias("lo"), hi.alias("hi")
    )
    # numpy widens a single value by half a unit to both sides
    left = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    right = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    width = (right - left) / bins
    return (
        every_bin.where(F.col("lo").isNotNull())
        .join(counts, "bin", "left")
        .select(
            "bin",
            (left + width * (F.col("bin") - 1)).alias("bin_lo"),
            (left + width * F.col("bin")).alias("bin_hi"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def chart_engagement_box(posts: DataFrame, cap_quantile: float = 0.95) -> DataFrame:
    """Per platform: five-number summary of the rows up to the global cap quantile."""
    numbers = _with_number(posts)
    cap = quantiles(numbers, "engagement", {"cap": cap_quantile}).select("cap").scalar()
    kept = numbers.where(F.col("platform").isNotNull() & (F.col("engagement") <= cap))
    five = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    return quantiles(kept, "engagement", five, ("platform",)).withColumnRenamed("n_values", "n")


# --- text ---------------------------------------------------------------------


def _with_length(posts: DataFrame) -> DataFrame:
    return posts.withColumn("text_length", F.length(F.coalesce(F.col("text"), F.lit(""))))


def text_length_summary(posts: DataFrame) -> DataFrame:
    sized = _with_length(posts)
    median = quantiles(sized, "text_length", {"median": 0.5}).select("median").scalar()
    return sized.agg(
        round_half_even(F.avg("text_length"), 1).alias("mean"),
        F.max("text_length").alias("max"),
        F.count_if(F.col("text_length") < 5).alias("very_short_lt5"),
        F.count_if(F.col("text_length") > 200).alias("very_long_gt200"),
    ).withColumn("median", F.floor(median).cast("int"))


def chart_length_hist(posts: DataFrame, bins: int = 40) -> DataFrame:
    """platform, platform_median, bin, bin_lo, bin_hi, n, density (bins without rows are left out)."""
    sized = _with_length(posts).where(F.col("platform").isNotNull())
    # Length is a small-range integer: counting equal lengths first leaves little to shuffle or sort.
    lengths = sized.groupBy("platform", "text_length").agg(F.count(F.lit(1)).alias("n"))
    spans = lengths.groupBy("platform").agg(
        F.min("text_length").cast("double").alias("lo"),
        F.max("text_length").cast("double").alias("hi"),
        F.sum("n").alias("n_platform"),
    )
    medians = quantiles(sized, "text_length", {"platform_median": 0.5}, ("platform",)).drop("n_values")
    placed = lengths.join(spans, "platform").withColumn(
        "bin", _bin_of(F.col("text_length").cast("double"), F.col("lo"), F.col("hi"), bins)
    )
    left = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    right = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    width = (right - left) / bins
    return (
        placed.groupBy("platform", "bin", "lo", "hi", "n_platform")
        .agg(F.sum("n").alias("n"))
        .join(medians, "platform")
        .select(
            "platform",
            "platform_median",
            "bin",
            (left + width * (F.col("bin") - 1)).alias("bin_lo"),
            (left + width * F.col("bin")).alias("bin_hi"),
            "n",
            (F.col("n") / (F.col("n_platform") * width)).alias("density"),
        )
    )


def chart_top_posts(posts: DataFrame, n: int = 15) -> DataFrame:
    """The n posts with most engagement and their axis labels."""
    label = F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 40), F.lit("..."))
    if "platform" in posts.columns:
        label = F.concat(F.substring(F.coalesce("platform", F.lit("")), 1, 3), F.lit(" | "), label)
    columns = [c for c in ("id", "platform", "author", "engagement") if c in posts.columns]
    ranked = _with_number(posts).orderBy(F.desc("engagement"), F.asc("id")).limit(n)
    return ranked.select(*columns, label.alias("label"))


# --- quality ------------------------------------------------------------------


def text_copies(posts: DataFrame, snippet: int = 80, copies: str | None = None) -> DataFrame:
    """One row per distinct valid text: digest, its first characters, n.

    Texts are compared whole, by SHA-256, so only the digest and the snippet
    are shuffled, never the full texts. With a column ``copies`` a row stands
    for so many posts.
    """
    many = F.count(F.lit(1)) if copies is None else F.sum(copies)
    return (
        posts.where(is_valid_text(F.col("text")))
        .groupBy(F.sha2("text", 256).alias("digest"), F.substring("text", 1, snippet).alias("snippet"))
        .agg(many.alias("n"))
    )


def composite_dup_count(posts: DataFrame) -> DataFrame:
    """Rows beyond the first per (platform, id), or per id without a platform column."""
    keys = ["platform", "id"] if "platform" in posts.columns else ["id"]
    copies = posts.where(F.col("id").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("composite_dup_count"))


def content_dup_count(posts: DataFrame) -> DataFrame:
    repeated = F.sum(F.when(F.col("n") > 1, F.col("n")))
    return text_copies(posts, 0).agg(F.coalesce(repeated, F.lit(0)).alias("content_dup_count"))


def empty_text_count(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count_if(~is_valid_text(F.col("text"))).alias("empty_text_count"))


def future_ts_count(posts: DataFrame, as_of) -> DataFrame:
    return posts.agg(F.count_if(F.col("ts") > F.lit(as_of)).alias("future_ts_count"))


def quality_summary(posts: DataFrame, as_of=None) -> DataFrame:
    """All four counts in one row; missing columns count 0."""
    zero = F.lit(0).cast("bigint")
    has = set(posts.columns)
    moment = F.current_timestamp() if as_of is None else F.lit(as_of)
    future = F.count_if(F.col("ts") > moment) if "ts" in has else F.max(zero)
    empty = F.count_if(~is_valid_text(F.col("text"))) if "text" in has else F.max(zero)
    return posts.agg(empty.alias("empty_text_count"), future.alias("future_ts_count")).select(
        (composite_dup_count(posts).scalar() if "id" in has else zero).alias("composite_dup_count"),
        (content_dup_count(posts).scalar() if "text" in has else zero).alias("content_dup_count"),
        "empty_text_count",
        "future_ts_count",
    )
