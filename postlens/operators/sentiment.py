"""Sentiment: ordered regex rules, weighted lexicon with negation, and their merge.

Everything is a projection over text_norm, tokens and lang; no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlens.functions.numbers import let, percent
from postlens.seeds import patterns as P, words as W
from postlens.seeds.patterns import DISTRESS, NEGATIVE, NEUTRAL, POSITIVE, UNCERTAIN

DISAGREEMENT_PCT = 15.0


@dataclass(frozen=True)
class Lexicon:
    """Word weights and negators of one language; intensifiers are carried but carry no weight."""

    positive: dict[str, int] = field(default_factory=dict)
    negative: dict[str, int] = field(default_factory=dict)
    negators: tuple[str, ...] = ()
    intensifiers: dict[str, int] = field(default_factory=dict)

    def weights(self) -> dict[str, int]:
        words = {**self.positive}
        for word, weight in self.negative.items():
            words[word] = words.get(word, 0) + weight
        return words


# zh is listed and empty, zh-CN falls back to it: both give UNCERTAIN, like any language not listed.
DEFAULT_LEXICONS = {
    "zh-TW": Lexicon(W.ZH_TW_POSITIVE, W.ZH_TW_NEGATIVE, tuple(W.ZH_TW_NEGATORS), W.ZH_TW_INTENSIFIERS),
    "zh": Lexicon(),
    "en": Lexicon(W.EN_POSITIVE, W.EN_NEGATIVE, tuple(W.EN_NEGATORS), W.EN_INTENSIFIERS),
}


def lexicon_table(spark: SparkSession, lexicons: dict[str, Lexicon] | None = None) -> DataFrame:
    """lang, kind, term, weight (0 for negators)."""
    rows = []
    for lang, lexicon in (lexicons or DEFAULT_LEXICONS).items():
        for kind in ("positive", "negative", "intensifiers"):
            rows += [(lang, kind.rstrip("s"), term, weight) for term, weight in getattr(lexicon, kind).items()]
        rows += [(lang, "negator", term, 0) for term in lexicon.negators]
    return spark.createDataFrame(rows, "lang string, kind string, term string, weight int")


def _verdict(label: str, conf: float) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(conf).cast("double").alias("conf"))


def tier1_rules(text: Column, lang: Column) -> Column:
    """struct(label, conf): the first rule that fires; 0.05 NEUTRAL means none did."""
    zh = lang.startswith("zh")
    return (
        F.when(text.isNull() | (text == ""), _verdict(UNCERTAIN, 0.0))
        .when(F.when(zh, text.rlike(P.SARCASM_ZH)).otherwise(text.rlike(P.SARCASM_EN)), _verdict(UNCERTAIN, 0.55))
        .when(F.when(zh, text.rlike(P.DISTRESS_ZH)).otherwise(text.rlike(P.DISTRESS_EN)), _verdict(DISTRESS, 0.85))
        .when(zh & text.rlike(P.ANNOUNCEMENT_ZH), _verdict(NEUTRAL, 0.7))
        .when(zh & text.rlike(P.NEGATIVE_RHETORIC_ZH), _verdict(NEGATIVE, 0.65))
        .when(zh & text.rlike(P.POSITIVE_RHETORIC_ZH), _verdict(POSITIVE, 0.6))
        .otherwise(_verdict(NEUTRAL, 0.05))
    )


def _weight_of(token: Column, lexicon: Lexicon) -> Column:
    """Weight by hashed set membership, one set per distinct weight."""
    by_weight: dict[int, list[str]] = {}
    for word, weight in lexicon.weights().items():
        if weight:
            by_weight.setdefault(weight, []).append(word)
    if not by_weight:
        return F.lit(0)
    chain = None
    for weight, words in sorted(by_weight.items()):
        chain = (F if chain is None else chain).when(token.isin(words), F.lit(weight))
    return chain.otherwise(F.lit(0))


def lexicon_score(tokens: Column, lexicon: Lexicon) -> Column:
    """struct(score, hits): weights summed, flipped after a negator among the two tokens before."""
    negators = list(lexicon.negators)

    def signed(token: Column, i: Column) -> Column:
        weight = _weight_of(token, lexicon)
        if not negators:
            return weight
        window = F.slice(tokens, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)))
        flipped = F.exists(window, lambda before: before.isin(negators))
        return F.when(weight == 0, F.lit(0)).when(flipped, -weight).otherwise(weight)

    # Few tokens carry weight, so the sum runs over those only.
    polar = F.filter(F.transform(tokens, signed), lambda w: w != 0)
    return let(
        polar,
        lambda ws: F.struct(
            F.aggregate(ws, F.lit(0), lambda total, w: total + w).alias("score"), F.size(ws).alias("hits")
        ),
    )


def tier2_from_score(scored: Column) -> Column:
    """struct(label, conf, score) from struct(score, hits); null means no lexicon for the language."""
    score, hits = scored["score"], scored["hits"]
    conf = F.least(F.lit(1.0), hits / 5.0)
    label = (
        F.when(scored.isNull(), UNCERTAIN)
        .when(hits == 0, NEUTRAL)
        .when(score >= 1, POSITIVE)
        .when(score <= -5, DISTRESS)
        .when(score <= -1, NEGATIVE)
        .otherwise(NEUTRAL)
    )
    certainty = (
        F.when(scored.isNull(), 0.0).when(hits == 0, 0.3).when(score == 0, conf * 0.7).otherwise(conf)
    )
    return F.struct(label.alias("label"), certainty.alias("conf"), F.coalesce(score, F.lit(0)).alias("score"))


def score_by_language(tokens: Column, lang: Column, lexicons: dict[str, Lexicon]) -> Column:
    branch = None
    for tag, lexicon in lexicons.items():
        if lexicon.weights():
            branch = (F if branch is None else branch).when(lang == tag, lexicon_score(tokens, lexicon))
    if branch is None:
        return F.lit(None).cast("struct<score:int,hits:int>")
    return branch


def combine_tiers(
    t1: Column, t2: Column, t1_conf: Column, t2_conf: Column, prefer_specific: bool = False
) -> Column:
    """struct(label, agreed).

    Two equal polarities take the surer label (tier 1 on a tie);
    ``prefer_specific`` lets distress win there instead.
    """

    def outcome(label: Column, agreed: bool) -> Column:
        return F.struct(label.alias("label"), F.lit(agreed).alias("agreed"))

    def polarity(label: Column) -> Column:
        return F.when(label == POSITIVE, 1).when(label.startswith(NEGATIVE), -1).otherwise(0)

    surer = F.when(t1_conf >= t2_conf, t1).otherwise(t2)
    if prefer_specific:
        surer = F.when((t1 == DISTRESS) | (t2 == DISTRESS), F.lit(DISTRESS)).otherwise(surer)
    ahead = (
        F.when(t1_conf > t2_conf + 0.15, t1).when(t2_conf > t1_conf + 0.15, t2).otherwise(F.lit(UNCERTAIN))
    )
    asserted_1 = (t1_conf >= 0.5) & (t2_conf < t1_conf)
    asserted_2 = (t2_conf >= 0.5) & (t1_conf < t2_conf)
    return (
        F.when((t1 == UNCERTAIN) | (t2 == UNCERTAIN), outcome(F.lit(UNCERTAIN), False))
        .when(t1 == DISTRESS, outcome(t1, True))
        .when((t1 == NEUTRAL) & (t2 != NEUTRAL), outcome(F.when(asserted_1, t1).otherwise(t2), True))
        .when((t2 == NEUTRAL) & (t1 != NEUTRAL), outcome(F.when(asserted_2, t2).otherwise(t1), True))
        .when(polarity(t1) == polarity(t2), outcome(surer, True))
        .otherwise(outcome(ahead, False))
    )


def apply_domain_patterns(tier1: Column, text: Column, lang: Column, table: dict[str, list[tuple]]) -> Column:
    """Extra (pattern, flip, confidence) rules by language, ahead of the built-in ones.

    positive_to_negative gives NEGATIVE, negative_to_positive POSITIVE, ambiguous UNCERTAIN.
    """
    # Polarity flip -> label.
    label_of = {"positive_to_negative": NEGATIVE, "negative_to_positive": POSITIVE, "ambiguous": UNCERTAIN}
    branch = None
    for tag, rules in table.items():
        for pattern, flip, conf in rules:
            hit = (lang == tag) & text.rlike(pattern)
            branch = (F if branch is None else branch).when(hit, _verdict(label_of[flip], conf))
    return tier1 if branch is None else branch.otherwise(tier1)


def label_posts(
    prepared: DataFrame,
    lexicons: dict[str, Lexicon] | None = None,
    domain_patterns: dict[str, list[tuple]] | None = None,
    prefer_specific: bool = False,
) -> DataFrame:
    """Adds t1_label, t1_conf, t2_label, t2_conf, final_label, sentiment_agreed."""
    def tiers(post: Column) -> Column:
        rules = tier1_rules(post["text"], post["lang"])
        if domain_patterns:
            rules = apply_domain_patterns(rules, post["text"], post["lang"], domain_patterns)
        scored = score_by_language(post["tokens"], post["lang"], lexicons or DEFAULT_LEXICONS)
        return F.struct(rules.alias("t1"), let(scored, tier2_from_score).alias("t2"))

    def merge(both: Column) -> Column:
        t1, t2 = both["t1"], both["t2"]
        merged = combine_tiers(t1["label"], t2["label"], t1["conf"], t2["conf"], prefer_specific)
        return F.struct(t1.alias("t1"), t2.alias("t2"), merged.alias("final"))

    post = F.struct(F.col("text_norm").alias("text"), "lang", "tokens")
    return (
        prepared.withColumn("verdict", let(let(post, tiers), merge))
        .withColumns(
            {
                "t1_label": F.col("verdict.t1.label"),
                "t1_conf": F.col("verdict.t1.conf"),
                "t2_label": F.col("verdict.t2.label"),
                "t2_conf": F.col("verdict.t2.conf"),
                "final_label": F.col("verdict.final.label"),
                "sentiment_agreed": F.col("verdict.final.agreed"),
            }
        )
        .drop("verdict")
    )


def sentiment_summary(labelled: DataFrame) -> DataFrame:
    """row_count, disagreement_pct, uncertain_pct and one count per label."""
    counts = [
        F.count_if(F.col("final_label") == label).alias("n_" + label.lower().replace("-", "_")) for label in P.LABELS
    ]
    return (
        labelled.agg(
            F.count(F.lit(1)).alias("row_count"), F.count_if(~F.col("sentiment_agreed")).alias("disputed"), *counts
        )
        .withColumn(
            "disagreement_pct", percent(F.col("disputed"), F.greatest(F.col("row_count"), F.lit(1)))
        )
        .withColumn(
            "uncertain_pct", percent(F.col("n_uncertain"), F.greatest(F.col("row_count"), F.lit(1)))
        )
        .drop("disputed")
    )


def calibration_sample(labelled: DataFrame, threshold_pct: float = DISAGREEMENT_PCT, n: int = 10) -> DataFrame:
    """The n disputed posts with most engagement, or nothing when few posts are disputed."""
    share = sentiment_summary(labelled).select("disagreement_pct").scalar()
    has = set(labelled.columns)
    weight = F.coalesce(F.col("engagement").try_cast("double"), F.lit(0.0)) if "engagement" in has else F.lit(0.0)
    return (
        labelled.where(~F.col("sentiment_agreed") & (share > threshold_pct))
        .select(
            "id",
            F.substring("text", 1, 200).alias("text"),
            "t1_label",
            "t1_conf",
            "t2_label",
            "t2_conf",
            "final_label",
            weight.alias("engagement"),
        )
        .orderBy(F.desc("engagement"), F.asc("id"))
        .limit(n)
    )
