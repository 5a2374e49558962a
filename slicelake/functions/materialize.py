"""Computed columns that are evaluated once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a one-row generator, which the optimizer does not inline.

    ``withColumn`` is merged into later expressions and so evaluated again at each use, inside a higher-order
    function once for each element; arrays that later steps index belong here.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` as one expression in which ``value`` is evaluated once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
