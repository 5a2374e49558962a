"""Ordered and grouped choices: fill-down, renumbering, first and longest of a group, top ranks, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_down(df: DataFrame, column: str, order: str, by: list[str]) -> DataFrame:
    """``column`` with NULLs replaced by the last value before them within ``by``; leading NULLs stay."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def renumber_replicates(df: DataFrame) -> DataFrame:
    """replicate: 2 for the largest of a species and condition, 1 for all others. NULL counts as another."""
    top = df.groupBy("species", "condition").agg(F.max("replicate").alias("_top"))
    return df.join(top, ["species", "condition"]).withColumn("replicate", F.when(F.col("replicate") == F.col("_top"), 2).otherwise(1)).drop("_top")


def longest_per_group(df: DataFrame, group: str, length: Column, ordinal: str, keep: list[str]) -> DataFrame:
    """The longest row of each group, the first by ``ordinal`` of equally long ones; rows without a group all stay.

    A map-side maximum of (length, -ordinal), so a hot group costs a task one partial row.
    """
    best = F.max(F.struct(F.coalesce(length, F.lit(-1)).alias("_len"), (-F.col(ordinal)).alias("_ord"), *keep)).alias("_best")
    chosen = df.where(F.col(group).isNotNull()).groupBy(group).agg(best).select(group, *[F.col(f"_best.{c}").alias(c) for c in keep])
    return chosen.unionByName(df.where(F.col(group).isNull()).select(group, *keep))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def top_values(df: DataFrame, tag: str, value: str, k: int = 5) -> DataFrame:
    """(tag, value, n, rank): the ``k`` most frequent values of each tag, ties by value. Counted before it is ranked."""
    counts = df.groupBy(tag, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(tag).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
