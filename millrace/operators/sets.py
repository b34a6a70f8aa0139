"""Unions, differences, grids, dataset expansion and date lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def stack(frames: Sequence[DataFrame], by_position: bool = False, fill: bool = False) -> DataFrame:
    """All rows of all frames, matched by name or by position."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.union(frame) if by_position else result.unionByName(frame, allowMissingColumns=fill)
    return result


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose keys do not occur in ``right``."""
    return left.join(right.select(*keys), list(keys), "left_anti")


def expanded(df: DataFrame, vector: str, copies: Mapping[str, Column]) -> DataFrame:
    """Every row once per named transformation of its array; other columns
    (the label) repeat. One explode, no second read."""
    variants = F.array(*[F.struct(F.lit(name).alias("kind"), column.alias("copy")) for name, column in copies.items()])
    return df.withColumn("_v", F.explode(variants)).select(*[c for c in df.columns if c != vector], "_v.kind", F.col("_v.copy").alias(vector))


def monthly_grid(df: DataFrame, key: str, day: str) -> DataFrame:
    """Every key with every month between the first and the last month of the
    whole table: an explode of a month sequence per distinct key."""
    month = F.trunc(day, "month")
    months = F.sequence(df.agg(F.min(month)).scalar(), df.agg(F.max(month)).scalar(), F.expr("interval 1 month"))
    return df.select(key).distinct().select(key, F.explode(months).alias("month"))


def latest_date(df: DataFrame, day: str, chosen: str) -> DataFrame:
    """The latest date not after ``chosen``, else the newest of all."""
    not_after = F.max(F.when(F.col(day) <= F.lit(chosen).cast("date"), F.col(day)))
    return df.agg(F.coalesce(not_after, F.max(day)).alias("as_of"), F.count_distinct(day).alias("n_dates"))
