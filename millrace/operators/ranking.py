"""Ranks, running totals and top-k that hold up when one group is huge.

A plain window sends each group to one task. Three forms here avoid that:

* ``top_k`` / ``first_by`` - a ``row_number() <= k`` filter. Spark keeps at most
  k rows of a group per map task before the exchange (WindowGroupLimit), so a
  hot group never travels whole.
* ``hash_rank`` - the exact rank in md5 order. The hash prefix cuts each group
  into even buckets; rank = rows in earlier buckets + rank inside the bucket.
* ``running_total`` / ``rank_in_order`` - the exact rank or cumulative sum for
  any order: a range-partitioned sort, sums per (partition, group), and an
  offset for the groups that continue from an earlier partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructField, StructType

from millrace.session import checkpoint

# Rows that one bucket of a hash order should have.
ROWS_PER_BUCKET = 100_000

def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys (grouping treats nulls as one group)."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in ``order``, numbered from 1."""
    numbered = df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return numbered.filter(F.col(rank) <= k)


def first_by(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the earliest in ``order`` (first write wins)."""
    return top_k(df, by, order, 1, "_first").drop("_first")


def hash_order(id_column: str | Column, seed: str) -> Column:
    """The md5 of ``id:seed``: a shuffle order that any engine reproduces."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.md5(F.concat(column.cast("string"), F.lit(":" + seed)))


def hash_rank(
    df: DataFrame,
    strata: Sequence[str],
    id_column: str,
    seed: str,
    rank: str = "rank",
    size: str | None = None,
    prefix: int | None = None,
) -> DataFrame:
    """Number the rows of each stratum in hash order; optionally add the
    stratum's row count as ``size``.

    ``prefix`` hex digits make ``16**prefix`` even buckets per stratum, so the
    work of one stratum spreads over as many tasks. Unless given, it follows
    from the row count: even one stratum of all rows has buckets of about
    ``ROWS_PER_BUCKET`` rows.
    """
    if prefix is None:
        prefix = max(1, math.ceil(math.log(max(df.count(), 1) / ROWS_PER_BUCKET, 16)))
    hashed = df.withColumn("_hash", hash_order(id_column, seed)).withColumn(
        "_bucket", F.substring("_hash", 1, prefix)
    )
    # Rows per stratum here: at most 16**prefix, never the rows themselves.
    whole = W.partitionBy(*strata) if strata else W.partitionBy(F.lit(0))
    earlier = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = hashed.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        *[F.col(c).alias("_s_" + c) for c in strata],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_size"),
    )
    condition = F.col("_bucket") == F.col("_b")
    for c in strata:
        condition = condition & F.col(c).eqNullSafe(F.col("_s_" + c))
    joined = hashed.join(offsets, condition)
    inside = W.partitionBy(*strata, "_bucket").orderBy("_hash", id_column)
    ranked = joined.withColumn(rank, F.row_number().over(inside) + F.col("_before"))
    if size:
        ranked = ranked.withColumn(size, F.col("_size"))
    return ranked.drop("_hash", "_bucket", "_b", "_before", "_size", *["_s_" + c for c in strata])


def running_total(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    weight: str | Column | None = None,
    out: str = "running",
) -> DataFrame:
    """Cumulative sum of ``weight`` (row number if None) inside each group.

    ``order`` must be unique within a group. The sort is range-partitioned on
    group and order together, so a hot group is cut along its order.
    """
    amount = F.lit(1).cast("long") if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    placed = checkpoint(
        df.withColumn("_w", amount).orderBy(*by, *order).withColumn("_pid", F.spark_partition_id())
    )
    sums = placed.groupBy(*by, "_pid").agg(F.sum("_w").alias("_part"))
    per_group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = per_group.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    # Only a group that continues over a partition border has an offset: one
    # group per border, so this table has fewer rows than there are partitions.
    offsets = (
        sums.withColumn("_offset", F.sum("_part").over(before))
        .filter(F.col("_offset").isNotNull())
        .select(*[F.col(c).alias("_g_" + c) for c in by], F.col("_pid").alias("_opid"), "_offset")
    )
    condition = F.col("_pid") == F.col("_opid")
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col("_g_" + c))
    kind = placed.schema["_w"].dataType.typeName()
    if kind in ("byte", "short", "integer", "long", "double"):
        # The rows of a written partition stand in order: one pass adds them up, without another exchange.
        local = placed.mapInArrow(
            _running_sums([placed.columns.index(c) for c in by], placed.columns.index("_w"), kind == "double"),
            StructType([*placed.schema.fields, StructField("_local", placed.select(F.sum("_w")).schema[0].dataType)]),
        )
    else:
        line = W.partitionBy("_pid", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        local = placed.withColumn("_local", F.sum("_w").over(line))
    return (
        local.join(F.broadcast(offsets), condition, "left")
        .withColumn(out, F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0)))
        .drop("_w", "_pid", "_local", "_opid", "_offset", *["_g_" + c for c in by])
    )


def _running_sums(keys: list[int], weight: int, real: bool):
    """Running sums per group over one sorted partition; the group at the end of a batch goes on in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            known = batch.column(weight).is_valid().to_numpy(zero_copy_only=False)
            w = pc.fill_null(batch.column(weight), 0).to_numpy(zero_copy_only=False).astype(float if real else np.int64)
            fresh = np.zeros(n, bool)
            for k in keys:
                column = batch.column(k)
                differ = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
                null = column.is_null().to_numpy(zero_copy_only=False)
                fresh[1:] |= differ | (null[1:] != null[:-1])
            first = [batch.column(k)[0].as_py() for k in keys]
            fresh[0] = last is None or first != last[0]
            starts = np.flatnonzero(fresh).tolist()
            out, seen = np.empty(n, w.dtype), np.empty(n, bool)
            for a, b in zip([0, *starts], [*starts, n], strict=True):
                if a < b:
                    goes_on = not fresh[a]
                    out[a:b] = np.cumsum(np.concatenate([[carry if goes_on else 0], w[a:b]]).astype(w.dtype))[1:]
                    seen[a:b] = np.cumsum(known[a:b]) + (last[1] if goes_on and last else 0) > 0
            carry, last = out[-1], ([batch.column(k)[n - 1].as_py() for k in keys], int(seen[-1]))
            # As in SQL, a sum of nothing but nulls is null.
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, mask=~seen)], names=[*batch.schema.names, "_local"])

    return run


def rank_in_order(df: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """The exact row number of every row in its group, for a unique order."""
    return running_total(df, by, order, None, rank)


def value_ranks(df: DataFrame, value: str, rank: str = "rank", ties: str | None = None) -> DataFrame:
    """Every distinct value with the mean of the places its rows share."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).filter(F.col(value).isNotNull())
    placed = running_total(counts, [], [F.col(value)], "_n", "_cum")
    return placed.select(
        F.col(value).alias("_v"),
        (F.col("_cum") - (F.col("_n") - 1) / F.lit(2.0)).alias(rank),
        *([F.col("_n").alias(ties)] if ties else []),
    )


def average_rank(df: DataFrame, value: str, rank: str = "rank", ties: str | None = None) -> DataFrame:
    """Rank with ties sharing the mean of their places; a row without a value keeps a null rank.

    Ranks are worked out over distinct values; the rows get them by a join.
    """
    return df.join(value_ranks(df, value, rank, ties), F.col(value) == F.col("_v"), "left").drop("_v")
