"""Top-k rows per group, safe when one group holds a large part of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 64


def top_k_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int, spread_by: str) -> DataFrame:
    """Adds ``rank`` (1..k). First k per (group, salt), then k of those per group.

    Both steps plan as WindowGroupLimit, so every task keeps k rows per group
    before its shuffle.
    """
    salted = Window.partitionBy(*groups, "salt").orderBy(*order)
    final = Window.partitionBy(*groups).orderBy(*order)
    return (
        df.withColumn("salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
        .withColumn("rank", F.row_number().over(salted))
        .where(F.col("rank") <= k)
        .drop("salt")
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
    )
