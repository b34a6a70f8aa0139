"""Grouped summaries: counts, shares, profiles, histograms, quantiles, funnels,
removal reports, utilisation, text blobs and model evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.operators.ranking import average_rank, rank_in_order, running_total


def steady_round(value: Column, places: int = 6) -> Column:
    """Round in two steps, so that a mean that is an exact half at the last
    place does not depend on the order of summation."""
    return F.round(F.round(value, places + 4), places)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of the total per value."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)


def conditional_counts(df: DataFrame, cells: Mapping[str, Column]) -> DataFrame:
    """Any number of named conditions counted in one pass, one row each."""
    counted = df.agg(*[F.count_if(condition).alias(name) for name, condition in cells.items()])
    return counted.unpivot([], list(cells), "cell", "n")


def answered(column: str) -> Column:
    """Not null and not empty."""
    return F.col(column).isNotNull() & (F.col(column) != "")


def removal_report(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """How many rows each successive filter removes, in one pass.

    A row counts at the first step it fails; an unknown (null) condition fails.
    """
    failed = F
    for index, (_, keep) in enumerate(steps):
        failed = failed.when(~F.coalesce(keep, F.lit(False)), index)
    once = df.agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count_if(failed == i).alias(f"_r{i}") for i in range(len(steps))],
    )
    rows, left = [], F.col("_all")
    for i, (reason, _) in enumerate(steps):
        left = left - F.col(f"_r{i}")
        rows.append(F.struct(F.lit(i + 1).alias("step"), F.lit(reason).alias("reason"),
                             F.col(f"_r{i}").alias("number_samples_removed"), left.alias("remaining")))
    return once.select(F.inline(F.array(*rows)))


def rate_by_group(df: DataFrame, by: str, hit: Column) -> DataFrame:
    """Whole-percent rate of ``hit`` per group; unknown counts as no hit."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(100 * F.count_if(hit) / F.count(F.lit(1))).cast("long").alias("rate_percent"),
    )


def min_max(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def means_one_and_two_keys(df: DataFrame, first: str, second: str, value: str, places: int = 6) -> DataFrame:
    """Mean per first key (second null) and per both keys, from one scan: the
    sums of the finer level are added up for the coarser one."""
    fine = df.groupBy(first, second).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    both = fine.groupingSets([[first], [first, second]], first, second).agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("n"), F.grouping(second).alias("_all")
    )
    return both.select(
        first, second, (F.col("_all") == 1).alias("all_second"), "n",
        F.round(F.try_divide(F.col("_s"), F.col("n")), places).alias("mean"),
    )


# --- exact quantiles -----------------------------------------------------------


def weighted_quantiles(counts: DataFrame, by: Sequence[str], value: str, weight: str, probs: Mapping[str, float]) -> DataFrame:
    """Interpolated quantiles per group from (group, value, count) rows.

    Works on distinct values with running counts, so nothing per group has to
    fit in one task, unlike an aggregate that keeps all values of a group.
    """
    known = counts.filter(F.col(value).isNotNull())
    totals = known.groupBy(*by).agg(F.sum(weight).alias("_total"))
    placed = running_total(known.select(*by, value, weight), by, [F.col(value)], weight, "_cum")
    names = ["_t_" + c for c in by]
    condition = F.lit(True)
    for c, name in zip(by, names):
        condition = condition & F.col(c).eqNullSafe(F.col(name))
    if by:
        sized = placed.join(totals.select(*[F.col(c).alias(n) for c, n in zip(by, names)], "_total"), condition)
    else:
        sized = placed.withColumn("_total", totals.scalar())
    parts = []
    for name, p in probs.items():
        place = (F.col("_total") - 1) * F.lit(float(p))
        parts += [
            F.min(F.when(F.col("_cum") > F.floor(place), F.col(value))).alias("_lo_" + name),
            F.min(F.when(F.col("_cum") > F.ceil(place), F.col(value))).alias("_hi_" + name),
        ]
    found = sized.groupBy(*by).agg(F.max("_total").alias("_total"), *parts)
    fraction = {n: (F.col("_total") - 1) * F.lit(float(p)) - F.floor((F.col("_total") - 1) * F.lit(float(p))) for n, p in probs.items()}
    return found.select(
        *by,
        F.col("_total").alias("n"),
        *[F.round(F.col("_lo_" + n) + (F.col("_hi_" + n) - F.col("_lo_" + n)) * fraction[n], 6).alias(n) for n in probs],
    )


BOX = {"lowest": 0.0, "lower": 0.25, "median": 0.5, "upper": 0.75, "highest": 1.0}


def box_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Five-number summary and mean per group."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    means = df.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"))
    return weighted_quantiles(counts, by, value, "_n", BOX).join(means, list(by))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: nulls, unique values (null counts as one), min, max,
    mean, standard deviation and quartiles.

    Uniques and quartiles share the counts of (column, value); mean and
    deviation are a map-side aggregate of the scan.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "value")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_n"))
    uniques = counts.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_n"))), F.lit(0)).alias("n_null"),
        F.count(F.lit(1)).alias("n_unique"),
    )
    moments = long.groupBy("column_name").agg(
        steady_round(F.avg("value")).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("stddev")
    )
    quartiles = weighted_quantiles(counts, ["column_name"], "value", "_n", BOX)
    return uniques.join(moments, "column_name").join(quartiles, "column_name")


def label_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls and unique values per text column."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "value")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_n"))), F.lit(0)).alias("n_null"),
        F.count(F.lit(1)).alias("n_unique"),
    )


# --- histograms ----------------------------------------------------------------


def histogram_equal_bins(df: DataFrame, value: str, bins: int, density: bool = False) -> DataFrame:
    """``bins`` equal bins from minimum to maximum, [low, high) with the last
    one closed; empty bins included."""
    numbers = df.select(F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    low = numbers.agg(F.min("_v")).scalar()
    width = (numbers.agg(F.max("_v") - F.min("_v")).scalar()) / bins
    # A constant column has bins of no width: all of it is in the first one.
    index = F.when(width == 0, 0).otherwise(F.least(F.floor(F.try_divide(F.col("_v") - low, width)), F.lit(bins - 1)))
    counts = numbers.groupBy(index.cast("long").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    frame = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, F.col("bin") == F.col("_bin"), "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    columns = ["bin", F.round(low + F.col("bin") * width, 6).alias("low"), F.round(low + (F.col("bin") + 1) * width, 6).alias("high"), n.alias("n")]
    if density:
        columns.append(F.round(F.try_divide(n, numbers.agg(F.count(F.lit(1))).scalar() * width), 9).alias("density"))
    return frame.select(*columns)


def histogram_breaks(df: DataFrame, value: str, breaks: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Counts between fixed breaks, (low, high] with the first one closed at
    both ends; empty bins included. Values below the first break are bin -1
    (without a low end), values above the last one the bin after the last
    (without a high end), so that the counts sum to all known values."""
    edges = [float(b) for b in breaks]
    v, last = F.col(value), len(edges) - 1
    bin_of = F.when(v < edges[0], -1).otherwise(sum((F.when(v > b, 1).otherwise(0) for b in edges[1:]), F.lit(0)))
    counted = df.filter(v.isNotNull()).groupBy(*by).agg(*[F.count_if(bin_of == i).alias(str(i)) for i in range(-1, last + 1)])
    border = lambda i: F.lit(edges[i] if 0 <= i <= last else None).cast("double")
    rows = [F.struct(F.lit(i).cast("long").alias("bin"), border(i).alias("low"), border(i + 1).alias("high"), F.col(str(i)).alias("n")) for i in range(-1, last + 1)]
    return counted.select(*by, F.inline(F.array(*rows)))


# --- plants --------------------------------------------------------------------


def utilisation(df: DataFrame, by: Sequence[str], demand: str, capacity: str, threshold: float | None = 50.0) -> DataFrame:
    """Demand as a percentage of capacity per group, above ``threshold``."""
    result = df.groupBy(*by).agg(F.sum(demand).alias("total_demand"), F.sum(capacity).alias("total_capacity")).withColumn(
        "utilization_rate", F.round(100 * F.try_divide(F.col("total_demand"), F.col("total_capacity")), 6)
    )
    return result if threshold is None else result.filter(F.col("utilization_rate") > threshold)


def shortfall(df: DataFrame, by: Sequence[str], demand: str, capacity: str) -> DataFrame:
    """Unmet demand: the sum of what exceeded capacity and how often."""
    short = F.col(demand) - F.col(capacity)
    return df.groupBy(*by).agg(F.sum(F.greatest(short, F.lit(0))).alias("shortfall"), F.count_if(short > 0).alias("times_short"))


def utilisation_change(monthly: DataFrame, product: str, month: str) -> DataFrame:
    """Change from the month before; a product has few months, so its window is small."""
    before = F.lag("utilization_rate").over(W.partitionBy(product).orderBy(month))
    return monthly.withColumn("previous_rate", before).withColumn("change", F.round(F.col("utilization_rate") - before, 6))


# --- ordered text --------------------------------------------------------------


def ordered_text(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], line: Column, separator: str = "\n", part_rows: int = 1000
) -> DataFrame:
    """The lines of each group joined in order, as numbered parts.

    A part holds at most ``part_rows`` lines, so a group of any size becomes
    several rows instead of one that a single task would have to build; the
    parts of a group joined by the separator are the whole text. ``order`` must
    be unique within a group.
    """
    ranked = rank_in_order(df.withColumn("_line", line), by, order, "_place")
    parts = ranked.withColumn("part", F.floor((F.col("_place") - 1) / part_rows).cast("long"))
    return (
        parts.groupBy(*by, "part")
        .agg(F.array_sort(F.collect_list(F.struct("_place", "_line"))).alias("_lines"))
        .select(*by, "part", F.size("_lines").cast("long").alias("n_lines"),
                F.array_join(F.transform("_lines", lambda x: x["_line"]), separator).alias("text"))
    )


# --- model outputs -------------------------------------------------------------


def ensemble_vote(df: DataFrame, item: str, probability: str, cut: float = 50.0) -> DataFrame:
    """Majority of per-model votes; a tie goes by the mean probability. A
    probability on the cut and a mean on a rounding border do not depend on the
    order in which they were summed."""
    vote = F.when(F.round(probability, 10) > cut, 1.0).otherwise(0.0)
    averaged = df.groupBy(item).agg(F.avg(vote).alias("mean_vote"), steady_round(F.avg(probability)).alias("mean_probability"))
    tie = (F.col("mean_vote") == 0.5) & (F.col("mean_probability") > cut)
    return averaged.withColumn("final_vote", F.when((F.col("mean_vote") > 0.5) | tie, 1).otherwise(0))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def accuracy_percent(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg((F.col(actual) == F.col(predicted)).cast("double")), 6).alias("accuracy_percent"))


def mean_squared_error(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    gap = F.col(predicted) - F.col(actual)
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(gap * gap), 6).alias("mse"))


def roc_auc(df: DataFrame, actual: str, score: str) -> DataFrame:
    """Area under the curve from average ranks, over distinct scores."""
    ranked = average_rank(df.filter(F.col(actual).isNotNull() & F.col(score).isNotNull()).select(actual, score), score, "_rank")
    sums = ranked.agg(
        F.sum(F.when(F.col(actual) == 1, F.col("_rank"))).alias("_w"),
        F.count_if(F.col(actual) == 1).alias("n_positive"),
        F.count_if(F.col(actual) == 0).alias("n_negative"),
    )
    p, n = F.col("n_positive").cast("double"), F.col("n_negative").cast("double")
    return sums.select("n_positive", "n_negative", F.round(F.try_divide(F.col("_w") - p * (p + 1) / 2, p * n), 9).alias("auc"))


def array_statistics(df: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """Mean and population deviation of each array position per group."""
    return (
        df.select(*by, F.posexplode(vector).alias("position", "_x"))
        .groupBy(*by, "position")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg(F.col("_x").cast("double")), 6).alias("mean"),
            F.round(F.stddev_pop(F.col("_x").cast("double")), 6).alias("stddev"),
        )
    )


def mean_and_spread(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation over folds, per epoch."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("stddev")
    )
