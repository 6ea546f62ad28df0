"""Dedup by identifiers, pairs and titles; top rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group; Spark drops later ones before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def running_sum(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = 4096) -> DataFrame:
    """rows with the sum of `value` up to each, by the whole number `order` within the keys.

    Two levels, so that a key with most of the rows is no task of its own:
    sums of stretches of `width` numbers are added up first, then the rows of
    each stretch.
    """
    cut = rows.withColumn("_stretch", F.floor(F.col(order) / width)).withColumn("_value", value)
    sums = cut.groupBy(*keys, "_stretch").agg(F.sum("_value").alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select(*keys, "_stretch", F.coalesce(ahead, F.lit(0)).alias("_before"))
    own = F.sum("_value").over(Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.join(before, [*keys, "_stretch"]).withColumn(name, F.col("_before") + own).drop("_stretch", "_value", "_before")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in order.  An aggregate, so copies collapse before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_row"))
    return first.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest if c not in keys))


def by_digest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key by `seq`, with the number of its rows as `matches`.

    A key may be a whole text: its length and SHA-256 are shuffled in its place.
    """
    rest = [c for c in rows.columns if c != key]
    marked = rows.select(*rest, F.unhex(F.sha2(key, 256)).alias("_digest"), F.octet_length(key).alias("_size"))
    first = marked.groupBy("_digest", "_size").agg(F.min(F.struct(seq, *(c for c in rest if c != seq))).alias("_row"), F.count(F.lit(1)).alias("matches"))
    return first.select(*(F.col(f"_row.{c}").alias(c) for c in rest), "matches")


def match_counts(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(seq).alias(seq), F.count(F.lit(1)).alias("matches")).drop(*keys)


def best_pair(rows: DataFrame, pair: list[str], confidence: str, seq: str) -> DataFrame:
    """One row for each directed pair: the last of high confidence, else the first medium one, else the first."""
    rank = F.when(F.col(confidence) == "high", 0).when(F.col(confidence) == "medium", 1).otherwise(2)
    late = F.when(F.col(confidence) == "high", -F.col(seq)).otherwise(F.col(seq))
    best = rows.groupBy(*pair).agg(F.min_by(F.struct(*rows.columns), F.struct(rank, late)).alias("_row"))
    return best.select("_row.*")
