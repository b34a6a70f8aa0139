"""Rank tests, contingency tests and resampled power."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from millrace.operators.distributions import chi_square_tail, student_tails
from millrace.operators.ranking import hash_rank, running_total, value_ranks
from millrace.operators.selection import DifferenceMatrix


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def student_two_sided(t: float, df: int) -> float:
    """Two-sided tail of Student's t for a whole number of degrees of freedom,
    by the finite trigonometric series."""
    theta = math.atan2(abs(t), math.sqrt(df))
    sine, square = math.sin(theta), math.cos(theta) ** 2
    if df % 2:
        term, total = math.cos(theta), 0.0
        for j in range(1, (df - 1) // 2 + 1):
            total += term
            term *= square * 2 * j / (2 * j + 1)
        return 1.0 - 2.0 / math.pi * (theta + sine * total)
    term, total = 1.0, 0.0
    for j in range(1, df // 2 + 1):
        total += term
        term *= square * (2 * j - 1) / (2 * j)
    return 1.0 - sine * total


def student_critical(level: float, df: int) -> float:
    """The t with a two-sided tail of ``level``, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if student_two_sided(middle, df) > level else (low, middle)
    return (low + high) / 2


# --- rank-sum ------------------------------------------------------------------


def rank_sum(df: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """Rank-sum statistic W of the first group, z with tie and continuity
    correction, and its two-sided p value.

    Counts per (group, value) come first; ranks run over distinct values.
    """
    counts = (
        df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.count_if(F.col(group) == first).alias("n1"), F.count_if(F.col(group) == second).alias("n2"))
        .withColumn("n", F.col("n1") + F.col("n2"))
    )
    ranked = running_total(counts, [], [F.col(value)], "n", "cum").withColumn("rank", F.col("cum") - (F.col("n") - 1) / 2)
    n = F.col("n").cast("double")
    sums = ranked.agg(
        F.sum("n1").cast("double").alias("n_first"), F.sum("n2").cast("double").alias("n_second"),
        F.sum(F.col("rank") * F.col("n1")).alias("_r"), F.sum(n * n * n - n).alias("_ties"),
    )
    a, b = F.col("n_first"), F.col("n_second")
    total = a + b
    w = F.col("_r") - a * (a + 1) / 2
    sigma = F.sqrt(a * b / 12 * (total + 1 - F.col("_ties") / (total * (total - 1))))
    centred = w - a * b / 2
    z = (centred - F.signum(centred) * 0.5) / sigma
    made = sums.select("n_first", "n_second", F.round(w, 1).alias("w"), F.round(z, 6).alias("z"))
    row = made.first()
    p = None if row.z is None else normal_two_sided(row.z)
    return made.withColumn("p_value", F.lit(p).cast("double"))


def location_shift(df: DataFrame, group: str, value: str, first, second, level: float = 0.95) -> tuple[float | None, float | None, float | None]:
    """Median of all differences (first - second) and its interval.

    The differences are never listed: counts per distinct value come first, and
    the wanted places are found in the matrix of differences between two sorted
    sides (``selection.DifferenceMatrix``). Null for a side without values.
    """
    known = df.filter(F.col(group).isin(first, second)).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    counts = known.groupBy("v").agg(F.count_if(F.col("g") == first).alias("n1"), F.count_if(F.col("g") == second).alias("n2"))
    matrix = DifferenceMatrix(counts)
    pairs = matrix.pairs
    if pairs == 0:
        return None, None, None
    spread = 1.959963984540054 if level == 0.95 else _normal_critical(1 - level)
    half = spread * math.sqrt(pairs * (matrix.rows + matrix.columns + 1) / 12)
    places = [(pairs + 1) // 2, pairs // 2 + 1, max(1, math.floor(pairs / 2 - half)), min(pairs, math.ceil(pairs / 2 + half) + 1)]
    found = matrix.smallest(places)
    return (found[0] + found[1]) / 2, found[2], found[3]


def _normal_critical(level: float) -> float:
    low, high = 0.0, 40.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if normal_two_sided(middle) > level else (low, middle)
    return (low + high) / 2


# --- correlation and contingency -----------------------------------------------


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks of the rows where both are known."""
    known = df.select(F.col(x).alias("_x"), F.col(y).alias("_y")).dropna()
    pairs = known.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_w"))
    ranks_x = value_ranks(known, "_x", "_rx").withColumnRenamed("_v", "_x")
    ranks_y = value_ranks(known, "_y", "_ry").withColumnRenamed("_v", "_y")
    weighted = pairs.join(ranks_x, "_x").join(ranks_y, "_y")
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    n = known.agg(F.count(F.lit(1)).alias("n"))
    centre = (n.scalar() + 1) / 2
    sums = weighted.agg(
        F.sum(w * (a - centre) * (b - centre)).alias("_ab"), F.sum(w * (a - centre) * (a - centre)).alias("_aa"),
        F.sum(w * (b - centre) * (b - centre)).alias("_bb"), F.sum("_w").alias("n"),
    )
    return sums.select("n", F.round(F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb")), 9).alias("rho"))


def spearman_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """The rank correlation with t = rho * sqrt((n - 2) / (1 - rho^2)) and its two-sided p value (no continuity correction).

    No t and no p value for under three pairs or where a side does not vary; a
    perfect order has p 0.
    """
    made = spearman(df, x, y)
    row = made.first()
    t = p = None
    if row.rho is not None and row.n > 2:
        t = math.copysign(math.inf, row.rho) if abs(row.rho) >= 1 else row.rho * math.sqrt((row.n - 2) / (1 - row.rho * row.rho))
        p = 0.0 if math.isinf(t) else student_tails(t, row.n - 2)
    return made.withColumn("t", F.lit(t).cast("double")).withColumn("p_value", F.lit(p).cast("double"))


def chi_square_test(df: DataFrame, row: str, column: str) -> DataFrame:
    """The independence statistic with its p value; none for a table of one row or column."""
    made = chi_square(df, row, column)
    found = made.first()
    p = chi_square_tail(found.chi_square, found.degrees) if found.chi_square is not None and found.degrees else None
    return made.withColumn("p_value", F.lit(p).cast("double"))


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Independence statistic: N * (sum of n^2 / (row * column totals) - 1)."""
    known = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = known.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(row).agg(F.sum("n").alias("_row"))
    columns = cells.groupBy(column).agg(F.sum("n").alias("_column"))
    n = F.col("n").cast("double")
    fit = cells.join(rows, row).join(columns, column).agg(F.sum(n * n / (F.col("_row") * F.col("_column"))).alias("_f"), F.sum("n").alias("n"))
    shape = (rows.agg(F.count(F.lit(1))).scalar() - 1) * (columns.agg(F.count(F.lit(1))).scalar() - 1)
    return fit.select("n", F.round(F.col("n") * (F.col("_f") - 1), 6).alias("chi_square"), shape.cast("long").alias("degrees"))


# --- power ---------------------------------------------------------------------


def resampled_power(pilot: DataFrame, identifier: str, arm: str, timing: str, outcome: str, sizes: Sequence[int],
                    replicates: int = 1000, seed: str = "power", level: float = 0.05) -> DataFrame:
    """Share of resamples in which the arm effect without timer is significant.

    ``replicates`` samples of every size are drawn with replacement from the
    pilot table: draw j of replicate r takes the row numbered by the hash of
    (size, r, j). The saturated 2x2 model's robust (HC3) error of the arm effect
    needs only counts, sums and squares per cell.
    """
    spark = pilot.sparkSession
    numbered = hash_rank(pilot.select(identifier, arm, timing, outcome), [], identifier, seed, "_place")
    n_rows = pilot.count()
    draws = spark.createDataFrame([(int(n),) for n in sizes], "size int").select(
        "size", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    ).select("size", "replicate", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("draw"))
    key = F.md5(F.concat_ws("/", F.lit(seed), "size", "replicate", "draw"))
    drawn = draws.withColumn("_place", F.conv(F.substring(key, 1, 12), 16, 10).cast("long") % n_rows + 1)
    cells = (
        drawn.join(numbered, "_place")
        .groupBy("size", "replicate")
        .agg(*[
            f(F.when((F.col(arm) == g) & (F.col(timing) == 0), e)).alias(f"{name}{g}")
            for g in (0, 1)
            for name, f, e in (("n", F.count, F.lit(1)), ("s", F.sum, F.col(outcome)), ("q", F.sum, F.col(outcome) * F.col(outcome)))
        ])
    )

    def variance(g: int):
        # HC3 in a saturated model: sum e^2 / (1 - 1/n)^2 / n^2 = SS / (n - 1)^2.
        n = F.col(f"n{g}")
        return F.try_divide(F.col(f"q{g}") - F.col(f"s{g}") * F.col(f"s{g}") / n, (n - 1) * (n - 1))

    effect = F.try_divide(F.col("s1"), F.col("n1")) - F.try_divide(F.col("s0"), F.col("n0"))
    t = F.try_divide(effect, F.sqrt(variance(0) + variance(1)))
    critical = F.create_map(*[F.lit(x) for n in sizes for x in (int(n), student_critical(level, int(n) - 4))])
    hit = F.coalesce(F.abs(t) > F.element_at(critical, F.col("size")), F.lit(False))
    return cells.groupBy("size").agg(F.count(F.lit(1)).alias("n_replicates"), F.round(F.avg(hit.cast("double")), 6).alias("power"))
