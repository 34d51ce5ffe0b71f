"""Text columns: validity, normalisation steps, tokens. Native expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from postlens.functions.numbers import let
from postlens.functions.segment import segment
from postlens.seeds import patterns as P, words as W


def is_valid_text(text: Column) -> Column:
    """Not null and something left after stripping white space."""
    return F.coalesce(text.rlike(f"[^{P.SPACE_CHARS}]"), F.lit(False))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{P.SPACE_CHARS}]+|[{P.SPACE_CHARS}]+$", "")


def strip_rt_prefix(text: Column) -> Column:
    return F.regexp_replace(text, P.RT_PREFIX, "")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, P.URL, " ")


def strip_mentions(text: Column) -> Column:
    return F.regexp_replace(text, P.MENTION, " ")


def strip_hash_symbol(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("#"), F.lit("")), F.lit("＃"), F.lit(""))


def cap_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, P.REPEATED_MARK, "$1$1")


def collapse_space(text: Column) -> Column:
    """Runs of white space become one blank; single blanks, the usual case, are not touched."""
    # Tested against one range first: most characters lie outside it, and a class of many parts is slow at each of them.
    wide = F.regexp_replace(text, f"[\\u1680-\\u3000&&[{P.WIDE_SPACES}]]", " ")
    other = P.LATIN_SPACES.replace("\\x20", "")
    return F.trim(F.regexp_replace(wide, f"[{other}][{P.LATIN_SPACES}]*|\\x20[{P.LATIN_SPACES}]+", " "))


NORMALIZE_STEPS = (
    strip_rt_prefix,
    strip_urls,
    strip_mentions,
    strip_hash_symbol,
    cap_punctuation,
    collapse_space,
)


def normalize(text: Column) -> Column:
    """All steps in order; null becomes ''."""
    return reduce(lambda c, step: step(c), NORMALIZE_STEPS, F.coalesce(text, F.lit("")))


def script_language(text: Column, default: str = "auto", other=None) -> Column:
    """zh-TW / zh by script, ``default`` for short text, ``other(text)`` for the remaining scripts."""

    def by_script(t: Column) -> Column:
        return (
            F.when(t.isNull() | (F.length(strip_space(t)) < 3), F.lit(default))
            .when(t.rlike(P.CJK), F.when(t.rlike(P.TRADITIONAL), F.lit("zh-TW")).otherwise(F.lit("zh")))
            .otherwise(F.lit(default) if other is None else other(t))
        )

    return let(text, by_script)


def tokenize_latin(text: Column) -> Column:
    """Lower-cased runs of A-Z and apostrophes; other letters split words."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def dictionary_pattern(terms) -> str:
    """Longest term first; then runs of Latin letters and digits; then single characters."""
    longest_first = sorted(set(terms), key=lambda t: (-len(t), t))
    quoted = "|".join(f"\\Q{t}\\E" for t in longest_first)
    return f"(?s)(?:{quoted})|[A-Za-z0-9]+|." if quoted else "(?s)[A-Za-z0-9]+|."


def zh_dictionary(extra_terms=()) -> list[str]:
    """Every polar term plus the words that must stay whole; negators are single characters anyway."""
    return [
        *W.ZH_TW_POSITIVE,
        *W.ZH_TW_NEGATIVE,
        *W.ZH_TW_INTENSIFIERS,
        *W.ZH_TW_NEGATORS,
        *W.ZH_TW_EXTRA_WORDS,
        *extra_terms,
    ]


def tokenize_dictionary(text: Column, terms) -> Column:
    """Tokens by a term list (longest match from the left), or by a dict of word frequencies (likeliest path)."""
    if isinstance(terms, dict):
        return segment(text, terms)
    return F.regexp_extract_all(text, F.lit(dictionary_pattern(terms)), F.lit(0))


def filter_tokens(tokens: Column, stopwords=()) -> Column:
    """Strip edge punctuation; drop empty tokens, stopwords, single marks and pure digits."""
    edges = f"^[^{P.WORD_CHARS}]+|[^{P.WORD_CHARS}]+$"
    stripped = F.transform(tokens, lambda t: F.regexp_replace(t, edges, ""))
    stop = list(stopwords)

    def keep(token: Column) -> Column:
        wanted = ~token.isin("", "_") & ~token.rlike("^[\\p{Nd}²³¹⁰⁴-⁹₀-₉]+$")
        return wanted & ~token.isin(stop) if stop else wanted

    return F.filter(stripped, keep)


def latin_words(text: Column, stopwords=()) -> Column:
    """tokenize_latin and filter_tokens in one pattern: a run from its first to its last letter.

    Such tokens cannot be empty, marks or digits, so only stopwords are left to drop.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+(?:'+[a-z]+)*"), F.lit(0))
    stop = list(stopwords)
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def stopwords_for(language: str, extra: dict[str, list[str]] | None = None) -> list[str]:
    chosen = [*W.STOPWORDS.get(language, []), *(extra or {}).get(language, [])]
    if language.startswith("zh") and language != "zh":
        chosen += W.STOPWORDS["zh"]
    return list(dict.fromkeys(chosen))


def tokens_for_language(text: Column, language: str, terms=None, extra_stopwords=None) -> Column:
    stop = stopwords_for(language, extra_stopwords)
    if language.startswith("zh"):
        return filter_tokens(tokenize_dictionary(text, terms or zh_dictionary()), stop)
    return latin_words(text, stop)


def tokens_by_row(text: Column, lang: Column, terms=None, extra_stopwords=None) -> Column:
    """Tokens when the language differs by row: one branch per stopword list."""
    special = {tag for tag in {**W.STOPWORDS, **(extra_stopwords or {})} if stopwords_for(tag, extra_stopwords)}

    def choose(row: Column) -> Column:
        body, tag_of = row["text"], row["lang"]
        zh = tokens_for_language(body, "zh", terms, extra_stopwords)
        branches = [(tag_of == tag, tokens_for_language(body, tag, terms, extra_stopwords)) for tag in sorted(special)]
        branches.append((tag_of.startswith("zh"), zh))
        chain = reduce(lambda c, arm: c.when(*arm), branches[1:], F.when(*branches[0]))
        return chain.otherwise(latin_words(body))

    return let(F.struct(text.alias("text"), lang.alias("lang")), choose)


def char_trigrams(text: Column) -> Column:
    """Overlapping character triples, in order."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1))
