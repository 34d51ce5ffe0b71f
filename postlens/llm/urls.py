"""URL filter: host and path rules, then a listed set behind a blocked Bloom filter and an exact join.

The listed addresses are made canonical and put into a Bloom filter of 64-bit
words, one row a word: a hash gives the word, four others its bits, so a probe
is one equi-join on the word's number and one comparison. Rows whose bits are
all set go on to an exact hash join with the list, which removes the false
hits. The filter's size follows the list's (``BITS_PER_ENTRY``); it is
broadcast only below a row bound and joined by shuffle above.

Everything is DataFrame functions.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule and is not listed, so it is allowed; a rule counts for its host
and all subdomains when the path starts with the rule's, the longest one wins
(of equally long ones the first in order of its text); repeated rows are
judged each; an empty list allows what no rule blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from postlens.llm.tables import broadcast_if_small, stored

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
BITS_PER_ENTRY = 16
PROBES = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str = "url"):
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: str = "url"):
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical():
    """Host without a leading ``www.`` and a default port, path without double and trailing slashes and index pages."""
    name = F.regexp_replace(F.regexp_replace("host", r"^www\.", ""), ":(80|443)$", "")
    place = F.regexp_replace(F.regexp_replace("path", "/+", "/"), r"(index\.html?|default\.aspx?)$", "")
    return F.when(F.col("host") != "", F.concat(name, F.regexp_replace(place, "/$", "")))


def rule_of(rules=RULES):
    """The longest fitting rule as struct(verdict, rule), null where none fits."""
    best = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, _, rest = rule.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(f"/{rest}")
        best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(best)
    return best


def _word(address, n_words: int):
    return F.pmod(F.xxhash64(address), F.lit(n_words))


def _mask(address):
    """The bits of an address in its word: four six-bit parts of a second hash."""
    drawn = F.xxhash64(address, F.lit(PROBES))
    mask = F.lit(0).cast("bigint")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(drawn, 6 * i).bitwiseAND(F.lit(63))
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int")))
    return mask


def bloom_filter(listed: DataFrame, n_words: int) -> DataFrame:
    """listed(address) -> (word, bits): a row for each word with a bit set."""
    rows = listed.select(_word("address", n_words).alias("word"), _mask("address").alias("mask"))
    return rows.groupBy("word").agg(F.bit_or("mask").alias("bits"))


def words_for(entries: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(entries, 1) * BITS_PER_ENTRY / 64)))


def possible(pages: DataFrame, bloom: DataFrame, n_words: int) -> DataFrame:
    """The rows of pages(address, ...) whose bits are all set."""
    probe = pages.withColumn("_word", _word("address", n_words)).withColumn("_mask", _mask("address"))
    hit = probe.join(broadcast_if_small(bloom), F.col("_word") == F.col("word"))
    return hit.where(F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask")).drop("_word", "_mask", "word", "bits")


def shared_addresses(pages: DataFrame) -> DataFrame:
    """listed(url): one url of each canonical address that more than one page claims."""
    rows = pages.select("url").withColumn("host", host()).withColumn("path", path()).withColumn("address", canonical())
    counts = rows.where("address IS NOT NULL").groupBy("address").agg(F.count("*").alias("n"), F.min("url").alias("url"))
    return counts.where("n > 1").select("url")


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of pages(page_id, url); listed(url) are the blocked addresses."""
    parts = pages.select("page_id", "url").withColumn("host", host()).withColumn("path", path())
    found = parts.withColumn("fit", rule_of(rules)).withColumn("address", canonical())
    entries = listed.select("url").withColumn("host", host()).withColumn("path", path())
    entries = entries.select(canonical().alias("address")).where("address IS NOT NULL").distinct()
    entries = stored(entries, "listed-addresses")
    n_words = words_for(entries.count())
    bloom = stored(bloom_filter(entries, n_words), "bloom-words")
    open_rows = found.where("fit IS NULL AND address IS NOT NULL").select("address")
    maybe = possible(open_rows, bloom, n_words).distinct()
    sure = stored(maybe.join(entries, "address", "left_semi").select(F.col("address").alias("hit")), "listed-hits")
    key = F.coalesce("address", F.concat(F.lit("\n"), F.col("page_id").cast("string")))
    rows = found.withColumn("key", key).join(broadcast_if_small(sure), F.col("key") == F.col("hit"), "left")
    is_listed = F.col("fit").isNull() & F.col("hit").isNotNull()
    verdict = F.when(F.col("fit").isNotNull(), F.col("fit.verdict")).when(is_listed, "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), is_listed.alias("listed")
    )
