"""Wide to long, answer counts and contingency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def answer_counts(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """Rows per (item, answer), for all items in one pass."""
    return to_long(df, [], items, "item", "answer").groupBy("item", "answer").agg(F.count(F.lit(1)).alias("n"))


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    return df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))


def contingency_wide(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """One column per listed value. Naming the values spares the extra job that
    would look for them."""
    cells = [F.count_if(F.col(column) == value).alias(str(value)) for value in values]
    return df.groupBy(row).agg(*cells)
