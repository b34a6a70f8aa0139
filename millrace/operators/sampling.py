"""Reproducible samples, splits, folds and assignments.

Everything is drawn in md5 order of ``id:seed``: the same rows come out on any
engine and after any retry, and sizes are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.ranking import hash_order, hash_rank, top_k


def stratified_sample(df: DataFrame, strata: Sequence[str], id_column: str, fraction: float, seed: str) -> DataFrame:
    """The first round(fraction * n) rows of every stratum."""
    ranked = hash_rank(df, strata, id_column, seed, "_place", size="_n")
    return ranked.filter(F.col("_place") <= F.round(F.col("_n") * F.lit(float(fraction)))).drop("_place", "_n")


def complement(df: DataFrame, sample: DataFrame, id_column: str) -> DataFrame:
    """The rows whose id is not in the sample."""
    return df.join(sample.select(id_column), id_column, "left_anti")


def labelled_split(df: DataFrame, strata: Sequence[str], id_column: str, parts: Mapping[str, float], seed: str, out: str = "part") -> DataFrame:
    """Name the part of every row: each part takes floor(fraction * n) rows of
    the stratum in hash order; what rounding leaves over is ``rest``."""
    ranked = hash_rank(df, strata, id_column, seed, "_place", size="_n")
    return ranked.withColumn(out, _part_of(F.col("_place"), F.col("_n"), parts)).drop("_place", "_n")


def balanced_split(df: DataFrame, label: str, model_label, id_column: str, parts: Mapping[str, float], seed: str, out: str = "part") -> DataFrame:
    """The same with the part sizes of one label used for all labels, so the
    classes are equal; the surplus of larger classes is ``rest``."""
    ranked = hash_rank(df, [label], id_column, seed, "_place")
    size = df.filter(F.col(label) == model_label).agg(F.count(F.lit(1))).scalar()
    return ranked.withColumn(out, _part_of(F.col("_place"), size, parts)).drop("_place")


def _part_of(place: Column, size: Column, parts: Mapping[str, float]) -> Column:
    chain, bound = F, F.lit(0)
    for name, fraction in parts.items():
        bound = bound + F.floor(size * F.lit(float(fraction)))
        chain = chain.when(place <= bound, name)
    return chain.otherwise("rest")


def train_test(df: DataFrame, id_column: str, test_fraction: float, seed: str, strata: Sequence[str] = ()) -> DataFrame:
    """``part`` = test for the first ceil(fraction * n) rows, else train."""
    ranked = hash_rank(df, list(strata), id_column, seed, "_place", size="_n")
    is_test = F.col("_place") <= F.ceil(F.col("_n") * F.lit(float(test_fraction)))
    return ranked.withColumn("part", F.when(is_test, "test").otherwise("train")).drop("_place", "_n")


def folds(df: DataFrame, strata: Sequence[str], id_column: str, k: int, seed: str) -> DataFrame:
    """Stratified fold number 0..k-1."""
    ranked = hash_rank(df, strata, id_column, seed, "_place")
    return ranked.withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_place")


def head_per_class(df: DataFrame, label: str, id_column: str, n: int, seed: str) -> DataFrame:
    """The first n rows of every class in hash order."""
    ordered = df.withColumn("_hash", hash_order(id_column, seed))
    return top_k(ordered, [label], [F.col("_hash"), F.col(id_column)], n, "_place").drop("_hash", "_place")


def shuffled(df: DataFrame, id_column: str, seed: str, place: str = "place") -> DataFrame:
    """The rows with their place in a random but repeatable order."""
    return hash_rank(df, [], id_column, seed, place)


def random_assignment(df: DataFrame, id_column: str, seed: str) -> DataFrame:
    """2x2 assignment: the arm by a fair hash bit, then exactly half of each
    arm (rounded) to the timer."""
    armed = df.withColumn("arm", F.when(F.substring(hash_order(id_column, seed + "/arm"), 1, 1) < "8", 0).otherwise(1))
    ranked = hash_rank(armed, ["arm"], id_column, seed + "/timing", "_place", size="_n")
    return ranked.withColumn("timing", F.when(F.col("_place") <= F.round(F.col("_n") / 2), 1).otherwise(0)).drop("_place", "_n")
