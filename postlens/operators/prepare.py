"""Text preparation: language, normalised text, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlens.functions import text as T
from postlens.functions.numbers import let, round_half_even
from postlens.functions.quantiles import quantiles
from postlens.functions.ranking import top_k_per_group
from postlens.seeds import words as W

PROFILE_SIZE = 300
WORDS_PER_HIT = 12


def assign_language(posts: DataFrame, declared: str = "auto", text_col: str = "text_norm", detector=None) -> DataFrame:
    """The declared language for all rows; with 'auto' the script decides per row.

    ``detector`` gives the language column of rows that are neither short nor CJK.
    """
    if declared and declared != "auto":
        return posts.withColumn("lang", F.lit(declared))
    return posts.withColumn("lang", T.script_language(F.col(text_col), "auto", detector))


def trigram_counts(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", weight: Column | None = None
) -> DataFrame:
    """lang, trigram, n over lower-cased text; ``weight`` (1) is how often a row counts."""
    once = F.lit(1) if weight is None else weight
    return (
        labelled.where(F.col(lang_col).isNotNull())
        .select(F.col(lang_col).alias("lang"), once.alias("w"), F.explode(T.char_trigrams(F.lower(text_col))).alias("trigram"))
        .groupBy("lang", "trigram")
        .agg(F.sum("w").cast("bigint").alias("n"))
    )


def language_profiles(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    size: int = PROFILE_SIZE,
    weight: Column | None = None,
) -> DataFrame:
    """The ``size`` most frequent trigrams of each language: lang, trigram, n, rank."""
    counts = trigram_counts(labelled, text_col, lang_col, weight)
    return top_k_per_group(counts, ["lang"], [F.desc("n"), F.asc("trigram")], size, "trigram")


def detect_language(
    posts: DataFrame, profiles: DataFrame, text_col: str = "text", id_col: str = "id"
) -> DataFrame:
    """Adds lang: zh-TW or zh by script, 'auto' for short text, else the profile that covers most of the trigrams.

    ``profiles`` has lang and trigram. Each post's distinct trigrams, with
    their counts, are joined with it; ties go to the first tag, no hit gives
    'auto'. Posts that only differ in other columns share ``id_col``.
    """
    grams = posts.select(F.col(id_col).alias("gram_id"), F.explode(T.char_trigrams(F.lower(text_col))).alias("trigram"))
    grams = grams.groupBy("gram_id", "trigram").agg(F.count(F.lit(1)).alias("uses"))
    hits = grams.join(profiles.select(F.col("lang").alias("tag"), "trigram"), "trigram")
    hits = hits.groupBy("gram_id", "tag").agg(F.sum("uses").alias("hits"))
    best = hits.groupBy("gram_id").agg(F.min_by("tag", F.struct(-F.col("hits"), F.col("tag"))).alias("best"))
    joined = posts.join(best, posts[id_col] == best["gram_id"], "left")
    other = F.coalesce(F.col("best"), F.lit("auto"))
    return joined.withColumn("lang", T.script_language(F.col(text_col), "auto", lambda _: other)).drop("gram_id", "best")


def language_by_words(text: Column) -> Column:
    """The detector of a pipeline without profiles: the language with most of its frequent words in the text.

    Ties, and texts in which fewer than one word in ``WORDS_PER_HIT`` is known,
    give 'auto'. English is the one Latin-script language with a shipped lexicon.
    """

    def decide(words: Column) -> Column:
        hits = [F.struct(F.size(F.filter(words, lambda w: w.isin(known))).alias("n"), F.lit(tag).alias("tag"))
                for tag, known in W.FREQUENT_WORDS.items()]
        return let(F.array_sort(F.array(*hits), lambda a, b: b["n"] - a["n"]), lambda best: F.when(
            (F.get(best, F.lit(0))["n"] > F.get(best, F.lit(1))["n"]) & (F.get(best, F.lit(0))["n"] * WORDS_PER_HIT >= F.size(words)),
            F.get(best, F.lit(0))["tag"],
        ).otherwise(F.lit("auto")))

    return let(F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}']+"), F.lit(0)), decide)


def prepare_posts(
    posts: DataFrame, declared: str = "auto", terms=None, extra_stopwords=None, detector=None
) -> DataFrame:
    """Adds text_norm, lang, tokens, tokens_lem_str, token_count."""
    normal = assign_language(posts.withColumn("text_norm", T.normalize(F.col("text"))), declared, detector=detector)
    return add_tokens(normal, declared, terms, extra_stopwords)


def add_tokens(normal: DataFrame, declared: str = "auto", terms=None, extra_stopwords=None) -> DataFrame:
    if declared and declared != "auto":
        tokens = T.tokens_for_language(F.col("text_norm"), declared, terms, extra_stopwords)
    else:
        tokens = T.tokens_by_row(F.col("text_norm"), F.col("lang"), terms, extra_stopwords)
    return token_columns(normal.withColumn("tokens", tokens))


def token_columns(tokenized: DataFrame) -> DataFrame:
    return tokenized.withColumn("tokens_lem_str", F.array_join("tokens", " ")).withColumn(
        "token_count", F.size("tokens")
    )


def preprocess_summary(prepared: DataFrame) -> DataFrame:
    """row_count, median_token_count, empty_after_norm, very_short_lt3_tokens."""
    median = quantiles(prepared, "token_count", {"median": 0.5}).select(F.floor("median").cast("int")).scalar()
    return prepared.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(~T.is_valid_text(F.col("text_norm"))).alias("empty_after_norm"),
        F.count_if(F.col("token_count") < 3).alias("very_short_lt3_tokens"),
    ).withColumn("median_token_count", median)


def language_distribution(prepared: DataFrame) -> DataFrame:
    counts = prepared.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("pct", round_half_even(F.col("n") / whole * 100, 2))
