"""Columns that are evaluated once, however many expressions read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with new columns (names it lacks) that later projections read and do not repeat.

    The optimizer merges neighbouring projections by copying what a column stands for into everything that
    reads it; a chain of long expressions then grows with every step. It does not merge across a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
