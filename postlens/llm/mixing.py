"""Temperature mixing of sources: weights from exponentiated token shares, realised as block permutations.

A source with the share p of all tokens gets a weight in proportion to p^a.
The exponent a in [0, 1] is bisected to the largest one at which no source is
repeated more often than ``max_repeats`` times the least repeated one, or to
the one at which the weights reach a given entropy. With the budget left open,
it is set so that the least repeated source is used exactly once: no document
is left out. A given budget of tokens is shared out by weight; a source whose
quota is below its size then uses only the first documents of its permutation.

A source's quota is filled by epochs; in each, its documents come in an order
of their own, given by a hash of the id, the text's digest and the epoch. A
copy's place is the middle of its tokens in its source's quota, from 0 to 1, so
all sources run through evenly; ``block`` cuts the places into blocks of about
``block_tokens`` tokens, each with the target shares.

Everything is DataFrame functions. Running sums are taken in two steps, within
small hash ranges of a source and over the ranges' totals, so that a source
with a third of all rows is not one task's work. The driver sees only one
number a bisection step, and four totals.

Defined results: a null source is a source of its own; rows without tokens
(null or empty texts) count as one token; equal places are ordered by hash;
repeated rows are mixed each; an empty table gives an empty table; an input
column named like an output column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from postlens.llm.tables import stored

MAX_REPEATS = 2.0
BLOCK_TOKENS = 1 << 20
RANGE_ROWS = 2000
STEPS = 6
FANOUT = 32

ADDED = ["mix_weight", "epoch", "place", "block"]


def n_words(text: str = "text"):
    """Words of a text, at least one."""
    words = F.size(F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\t-\r]+", " ")), " "))
    return F.greatest(words, F.lit(1)).cast("bigint")


def totals(rows: DataFrame) -> DataFrame:
    """(source, size, share): tokens of each source and their share of all."""
    sums = stored(rows.groupBy("source").agg(F.sum("tokens").alias("size")), "source-sizes")
    whole = sums.agg(F.sum("size")).first()[0] or 1
    return sums.select("source", "size", (F.col("size") / F.lit(float(whole))).alias("share"))


def _measure(sources: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent: (entropy of the weights, most repeats over fewest)."""
    spread = sources.withColumn("a", F.explode(F.array(*map(F.lit, exponents))))
    raw = F.pow("share", F.col("a"))
    rows = (
        spread.groupBy("a")
        .agg(
            F.sum(raw).alias("z"),
            F.sum(raw * F.log(raw)).alias("zlog"),
            F.max(F.pow("share", F.col("a") - 1)).alias("most"),
            F.min(F.pow("share", F.col("a") - 1)).alias("least"),
        )
        .collect()
    )
    return {r["a"]: (math.log(r["z"]) - r["zlog"] / r["z"], r["most"] / r["least"]) for r in rows}


def bisect_exponent(sources: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None) -> float:
    """The exponent that meets the target. Each step asks Spark for ``FANOUT`` points of the bracket at once.

    Towards 0 both the entropy and the repeats grow. With an entropy, the
    largest exponent that reaches it (0 if none does); else the smallest one
    within the limit of repeats.
    """
    low, high = 0.0, 1.0
    if sources.isEmpty():
        return high
    for _ in range(STEPS):
        step = (high - low) / FANOUT
        points = [low + step * i for i in range(FANOUT + 1)]
        found = _measure(sources, points)
        if entropy is not None:
            fits = [p for p in points if found[p][0] >= entropy]
            if not fits:
                return 0.0
            low = max(fits)
        else:
            fits = [p for p in points if found[p][1] > max_repeats]
            if not fits:
                return low
            low = max(fits)
        high = min(low + step, high)
    return low if entropy is not None else high


def weights(sources: DataFrame, exponent: float, budget: int | None = None) -> DataFrame:
    """(source, size, mix_weight, quota): quota in tokens, for the budget or for at least one whole use of each."""
    raw = sources.withColumn("raw", F.pow("share", F.lit(exponent)))
    z, scale = raw.agg(F.sum("raw"), F.max(F.col("size") / F.col("raw"))).first()
    quota = F.col("raw") * F.lit(float(scale or 0) if budget is None else budget / (z or 1))
    return raw.select(
        "source", "size", (F.col("raw") / F.lit(z or 1.0)).alias("mix_weight"), F.round(quota).cast("bigint").alias("quota")
    )


def mix(
    docs: DataFrame,
    source: str = "source",
    tokens: str | None = None,
    max_repeats: float | None = MAX_REPEATS,
    entropy: float | None = None,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The rows of docs(doc_id, text or tokens, source, ...) as copies with mix_weight, epoch, place and block.

    ``tokens`` names a column of counts; without it words are counted. The
    sources' totals (one row a source) are stored and read several times.
    """
    carried = [c for c in docs.columns if c not in ADDED]
    count = n_words() if tokens is None else F.greatest(F.coalesce(F.col(tokens), F.lit(1)), F.lit(1)).cast("bigint")
    given = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("source"),
        count.alias("tokens"),
        F.struct(*carried).alias("row"),
    )
    key = F.xxhash64(F.col("row.doc_id"), F.col("row.text")) if "text" in carried else F.xxhash64(F.col("row.doc_id"))
    given = given.withColumn("key", key)
    sources = totals(given.select("source", "tokens"))
    shares = stored(weights(sources, bisect_exponent(sources, max_repeats, entropy), budget), "weights")
    whole = shares.agg(
        F.sum("size").alias("size"),
        F.sum("quota").alias("quota"),
        F.max(F.ceil(F.col("quota") / F.col("size"))).alias("epochs"),
    ).first()  # one row of totals
    epochs = int(whole["epochs"] or 0)
    n_blocks = max(1, round((whole["quota"] or 0) / block_tokens))
    n_ranges = max(1, math.ceil((whole["size"] or 0) / (RANGE_ROWS * 500)))
    wanted = shares.select(F.col("source").alias("of"), "size", "mix_weight", "quota")
    copies = (
        given.join(broadcast_sources(wanted), given["source"] == wanted["of"])
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max(epochs - 1, 0)))))
        .where(F.col("epoch") * F.col("size") < F.col("quota"))
        .withColumn("order", F.shiftrightunsigned(F.xxhash64("key", "epoch"), 1))
        .withColumn("range", F.floor(F.col("order") / F.lit(float(1 << 63)) * n_ranges).cast("int"))
    )
    return place(copies, n_blocks, carried)


def broadcast_sources(table: DataFrame) -> DataFrame:
    from postlens.llm.tables import broadcast_if_small

    return broadcast_if_small(table)


def place(copies: DataFrame, n_blocks: int, carried: list[str]) -> DataFrame:
    """Running sums within ranges, offsets of the ranges, and the copies inside their source's quota."""
    part = ["source", "epoch", "range"]
    sums = stored(copies.groupBy(*part).agg(F.sum("tokens").alias("range_tokens")), "ranges")
    before = Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("range").alias("r"),
        F.coalesce(F.sum("range_tokens").over(before), F.lit(0)).alias("ahead"),
    )
    running = Window.partitionBy(*part).orderBy("order", "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = copies.withColumn("within", F.coalesce(F.sum("tokens").over(running), F.lit(0)))
    rows = rows.join(
        broadcast_sources(offsets),
        (F.col("source") == F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("range") == F.col("r")),
    )
    begin = F.col("epoch") * F.col("size") + F.col("ahead") + F.col("within")
    rows = rows.withColumn("begin", begin).where(F.col("begin") < F.col("quota"))
    spot = F.least((F.col("begin") + F.col("tokens") / 2) / F.col("quota"), F.lit(1.0))
    return rows.withColumn("place", spot).select(
        "row.*", "mix_weight", F.col("epoch").cast("int").alias("epoch"), "place",
        F.least(F.floor(F.col("place") * n_blocks), F.lit(n_blocks - 1)).cast("bigint").alias("block"),
    )


def mixed_documents(docs: DataFrame, source: str = "source") -> DataFrame:
    """The copies in order of their places, with the columns of docs; those named like the mixture's are kept apart from it."""
    aside = {}
    for name in docs.columns:
        if name in ADDED:
            aside[name] = f"given_{name}"
            while aside[name] in docs.columns:
                aside[name] += "_"
    copies = mix(docs.withColumnsRenamed(aside), aside.get(source, source))
    ordered = copies.repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id")
    return ordered.select(*[F.col(aside.get(name, name)).alias(name) for name in docs.columns])
