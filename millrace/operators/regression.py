"""Linear, lasso, ridge and logistic regression as aggregates over the table.

The rows are reduced to a small matrix of sums on Spark; only matrices the size
of the model reach the driver. Gradient descent on squared error needs nothing
but those sums, so any number of epochs costs one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.session import checkpoint

LOCAL_CELLS = 100_000  # different regressors that descent keeps on the driver
ALIASED = 1e-9  # share of a column's variation that earlier columns must leave, or it is aliased


def standardised(df: DataFrame, columns: Sequence[str], ddof: int = 0, stats: dict | None = None) -> tuple[DataFrame, dict]:
    """Columns minus mean over deviation (ddof 0: population, 1: sample), and
    the means and deviations, which can be given back for other rows."""
    if stats is None:
        spread = F.stddev_pop if ddof == 0 else F.stddev_samp
        row = df.agg(*[f(c).alias(p + c) for c in columns for p, f in (("m_", F.avg), ("s_", spread))]).first()
        stats = {c: (row["m_" + c], row["s_" + c]) for c in columns}
    scaled = [
        F.try_divide(F.col(c) - F.lit(stats[c][0]), F.lit(stats[c][1])).alias(c) if c in stats else F.col(c) for c in df.columns
    ]
    return df.select(*scaled), stats


@dataclass
class Moments:
    """n, means and population covariances of some columns."""

    n: int
    mean: np.ndarray
    covariance: np.ndarray


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """One aggregate; Spark merges covariances without cancellation. Rows with
    a null in any of the columns are left out."""
    known = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = known.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    covariance = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        covariance[i, j] = covariance[j, i] = row[f"c{i}_{j}"]
    return Moments(row.n, np.array([row[f"m{i}"] for i in range(len(columns))]), covariance)


def coefficient_frame(spark: SparkSession, values: Mapping[str, float], places: int = 6) -> DataFrame:
    return spark.createDataFrame([(k, round(float(v), places)) for k, v in values.items()], "term string, estimate double")


def descent(m: Moments, alpha: float, epochs: int, slope_factor: float, penalty: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, float]:
    """Gradient descent on the mean squared error from zero weights.

    ``slope_factor`` is 2 for the gradient of the mean square and 1 for half of
    it; ``penalty(w)`` is added to the gradient of the weights. The last column
    of the moments is the target.
    """
    k = len(m.mean) - 1
    xx = m.covariance[:k, :k] + np.outer(m.mean[:k], m.mean[:k])
    xy = m.covariance[:k, k] + m.mean[:k] * m.mean[k]
    w, b = np.zeros(k), 0.0
    for _ in range(epochs):
        grad_w = -slope_factor * (xy - xx @ w - b * m.mean[:k]) + penalty(w)
        grad_b = -slope_factor * (m.mean[k] - m.mean[:k] @ w - b)
        w, b = w - alpha * grad_w, b - alpha * grad_b
    return w, b


def _named(columns: Sequence[str], w: np.ndarray, b: float) -> dict[str, float]:
    return {"intercept": b, **dict(zip(columns, w))}


def linear_descent(df: DataFrame, x: str, y: str, alpha: float, epochs: int) -> dict[str, float]:
    w, b = descent(moments(df, [x, y]), alpha, epochs, 2.0, lambda w: np.zeros_like(w))
    return _named([x], w, b)


def lasso_descent(df: DataFrame, columns: Sequence[str], y: str, alpha: float, epochs: int, penalty: float, quirk: bool = False) -> dict[str, float]:
    """Subgradient descent with an absolute penalty inside the 2/n factor.

    The penalty pulls weights to zero; ``quirk=True`` gives it the opposite
    sign, as the source formula does. A weight of zero takes the lower branch.
    """
    m = moments(df, [*columns, y])
    sign = -1.0 if quirk else 1.0
    w, b = descent(m, alpha, epochs, 2.0, lambda w: sign * 2.0 / m.n * penalty * np.where(w > 0, 1.0, -1.0))
    return _named(columns, w, b)


def ridge(df: DataFrame, columns: Sequence[str], y: str, penalty: float) -> dict[str, float]:
    """Closed form with the intercept left free."""
    m = moments(df, [*columns, y])
    k = len(columns)
    w = np.linalg.solve(m.n * m.covariance[:k, :k] + penalty * np.eye(k), m.n * m.covariance[:k, k])
    return _named(columns, w, m.mean[k] - m.mean[:k] @ w)


def ridge_descent(df: DataFrame, columns: Sequence[str], y: str, alpha: float, epochs: int, penalty: float, quirk: bool = False) -> dict[str, float]:
    """The same minimum by descent; ``quirk=True`` flips the penalty's sign."""
    m = moments(df, [*columns, y])
    sign = -1.0 if quirk else 1.0
    w, b = descent(m, alpha, epochs, 1.0, lambda w: sign * penalty / m.n * w)
    return _named(columns, w, b)


def prediction(coefficients: Mapping[str, float]) -> Column:
    """The linear model as a column expression."""
    return sum((F.lit(float(v)) * F.col(k) for k, v in coefficients.items() if k != "intercept"), F.lit(float(coefficients["intercept"])))


# --- sums of products by task --------------------------------------------------


def _summed_matrices(df: DataFrame, make: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of a matrix that ``make`` builds from a batch; each
    task sends one matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if not batch.empty:
                total += make(batch.to_numpy(dtype=float)).reshape(-1)
        yield pd.DataFrame({"m": [total]})

    parts = df.mapInPandas(run, "m array<double>")
    sums = parts.select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    result = np.zeros(size)
    for row in sums.collect():
        result[row.i] = row.x
    return result


# --- least squares with factors and robust errors ------------------------------


def levels_of(df: DataFrame, column: str, base: str | None = None, most: int | None = None) -> list:
    """The sorted values of a factor, the base first. A model has a column per level, so the caller may name the most it wants."""
    levels = df.select(column).filter(F.col(column).isNotNull()).distinct()
    found = sorted(row[0] for row in (levels if most is None else levels.limit(most + 1)).collect())
    if most is not None and len(found) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return found if base is None else [base] + [x for x in found if x != base]


def dummies(column: str, levels: Sequence) -> dict[str, Column]:
    """0/1 columns for all levels but the first (the base)."""
    return {f"{column}[{level}]": F.when(F.col(column) == level, 1.0).when(F.col(column).isNotNull(), 0.0) for level in levels[1:]}


@dataclass
class Fit:
    terms: list[str]
    estimate: np.ndarray
    bread: np.ndarray  # (X'X)^-1
    n: int
    residual_variance: float
    r_squared: float


def _design(df: DataFrame, terms: Mapping[str, Column], y: str) -> DataFrame:
    columns = [c.cast("double").alias(f"x{i}") for i, c in enumerate(terms.values())]
    return df.select(F.lit(1.0).alias("one"), *columns, F.col(y).cast("double").alias("y")).dropna()


def independent(gram: np.ndarray, use: Sequence[int]) -> list[int]:
    """The columns, in their order, that are no linear combination of earlier ones.

    Each column is reduced by those kept before it (a Cholesky factor grown row
    by row); one of which under ``ALIASED`` of its own variation is left is aliased.
    """
    kept: list[int] = []
    factor = np.zeros((0, 0))
    for c in use:
        row = np.array([gram[c, k] for k in kept])
        part = np.linalg.solve(factor, row) if kept else row
        left = gram[c, c] - part @ part
        if left > ALIASED * gram[c, c]:
            grown = np.zeros((len(kept) + 1, len(kept) + 1))
            grown[:-1, :-1], grown[-1, :-1], grown[-1, -1] = factor, part, np.sqrt(left)
            factor, kept = grown, [*kept, c]
    return kept


def _fit(gram: np.ndarray, centre: np.ndarray, names: list[str], use: list[int]) -> Fit:
    """The model on some columns of a matrix of sums around ``centre`` (column 0
    is the constant, the last one the target). Aliased columns get NaN and count as no terms."""
    last = len(gram) - 1
    own = independent(gram, use)
    at = [use.index(c) for c in own]
    xx, xy = gram[np.ix_(own, own)], gram[own, last]
    yy, n, k = gram[last, last], int(round(gram[0, 0])), len(own)
    shifted = np.linalg.solve(xx, xy)
    residual = yy - shifted @ xy
    back = np.eye(k)
    back[0, 1:] = -centre[own[1:]]
    estimate, bread = np.full(len(use), np.nan), np.zeros((len(use), len(use)))
    estimate[at] = back @ shifted
    estimate[0] += centre[last]
    bread[np.ix_(at, at)] = back @ np.linalg.inv(xx) @ back.T
    return Fit(["intercept", *names], estimate, bread, n, residual / (n - k), 1.0 - residual / (yy - gram[0, last] ** 2 / n))


def _gram(design: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of all columns around their means, and the means."""
    centre_row = design.agg(*[F.avg(c).alias(c) for c in design.columns[1:]]).first()
    centre = np.array([0.0, *centre_row])
    width = len(centre)

    def products(rows: np.ndarray) -> np.ndarray:
        shifted = rows - centre
        return shifted.T @ shifted

    return _summed_matrices(design, products, width * width).reshape(width, width), centre


def _meats(design: DataFrame, fits: Sequence[Fit], uses: Sequence[list[int]], kind: str) -> list[np.ndarray]:
    """The middle matrices of several models' robust errors, in one pass."""
    models = [(np.nan_to_num(fit.estimate), fit.bread, use) for fit, use in zip(fits, uses)]

    def meat(rows: np.ndarray) -> np.ndarray:
        parts = []
        for estimate, bread, use in models:
            x = rows[:, use]
            error = rows[:, -1] - x @ estimate
            if kind == "HC3":
                error = error / (1.0 - np.einsum("ij,jk,ik->i", x, bread, x))
            parts.append(((x * (error**2)[:, None]).T @ x).reshape(-1))
        return np.concatenate(parts)

    sizes = [len(use) ** 2 for use in uses]
    flat = _summed_matrices(design, meat, sum(sizes))
    ends = np.cumsum([0, *sizes])
    return [flat[a:b].reshape(len(use), len(use)) for a, b, use in zip(ends, ends[1:], uses)]


def _sandwich(fit: Fit, middle: np.ndarray, kind: str) -> np.ndarray:
    scale = fit.n / (fit.n - np.count_nonzero(~np.isnan(fit.estimate))) if kind == "HC1" else 1.0
    return scale * fit.bread @ middle @ fit.bread


def least_squares(df: DataFrame, terms: Mapping[str, Column], y: str) -> Fit:
    """Ordinary least squares with an intercept from one matrix of sums.

    Sums are taken around the means of the columns (one cheap aggregate), which
    keeps them accurate, and the intercept is moved back at the end.
    """
    gram, centre = _gram(_design(df, terms, y))
    return _fit(gram, centre, list(terms), list(range(len(terms) + 1)))


def robust_covariance(df: DataFrame, terms: Mapping[str, Column], y: str, fit: Fit, kind: str = "HC3") -> np.ndarray:
    """Heteroscedasticity-robust covariance, HC1 or HC3, from a second pass."""
    middle = _meats(_design(df, terms, y), [fit], [list(range(len(fit.terms)))], kind)[0]
    return _sandwich(fit, middle, kind)


def fit_frame(spark: SparkSession, model: str, fit: Fit, covariance: np.ndarray | None = None, places: int = 6) -> DataFrame:
    """(model, term, estimate, std_error, t_value); classic errors if no
    covariance is given. An aliased term has nulls."""
    used = fit.bread * fit.residual_variance if covariance is None else covariance
    error = np.sqrt(np.diag(used))
    rows = [
        (model, term, None, None, None) if np.isnan(b) else (model, term, round(float(b), places), round(float(e), places), round(float(b / e), 4))
        for term, b, e in zip(fit.terms, fit.estimate, error)
    ]
    return spark.createDataFrame(rows, "model string, term string, estimate double, std_error double, t_value double")


def nested_models(df: DataFrame, y: str, steps: Sequence[tuple[str, Mapping[str, Column]]], kind: str = "HC1") -> DataFrame:
    """Models that each add the terms of one step, with robust errors.

    All models share one matrix of sums and one pass for the errors, on the rows
    where every term is known.
    """
    everything = {name: column for _, added in steps for name, column in added.items()}
    design = _design(df, everything, y)
    gram, centre = _gram(design)
    fits, uses, names = [], [], []
    for _, added in steps:
        names = [*names, *added]
        uses.append(list(range(len(names) + 1)))
        fits.append(_fit(gram, centre, names, uses[-1]))
    middles = _meats(design, fits, uses, kind)
    frames = [fit_frame(df.sparkSession, step[0], fit, _sandwich(fit, m, kind)) for step, fit, m in zip(steps, fits, middles)]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def side_by_side(coefficients: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per term with an estimate and an error column per model."""
    cells = []
    for model in models:
        for value in ("estimate", "std_error"):
            cells.append(F.max(F.when(F.col("model") == model, F.col(value))).alias(f"{model}_{value}"))
    return coefficients.groupBy("term").agg(*cells)


# --- logistic ------------------------------------------------------------------


def _logistic_sums(df: DataFrame, columns: Sequence[str], y: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient, Hessian and log loss at ``weights``, in one pass."""
    k = len(columns) + 1
    design = df.select(F.lit(1.0).alias("one"), *[F.col(c).cast("double").alias(c) for c in columns], F.col(y).cast("double").alias("_y")).dropna()

    def sums(rows: np.ndarray) -> np.ndarray:
        x, target = rows[:, :k], rows[:, k]
        z = x @ weights
        p = 1.0 / (1.0 + np.exp(-np.abs(z)))
        p = np.where(z >= 0, p, 1.0 - p)
        loss = np.logaddexp(0.0, z) - target * z
        return np.concatenate([x.T @ (p - target), ((x * (p * (1 - p))[:, None]).T @ x).reshape(-1), [loss.sum()]])

    flat = _summed_matrices(design, sums, k + k * k + 1)
    return flat[:k], flat[k:k + k * k].reshape(k, k), float(flat[-1])


def logistic_newton(df: DataFrame, columns: Sequence[str], y: str, iterations: int = 8, tolerance: float = 1e-10) -> tuple[dict[str, float], list[float]]:
    """Few passes to the maximum likelihood; the losses of all passes too.

    Perfectly separable classes have no maximum: the weights then grow until
    ``iterations`` ends it.
    """
    weights, losses = np.zeros(len(columns) + 1), []
    for _ in range(iterations):
        gradient, hessian, loss = _logistic_sums(df, columns, y, weights)
        losses.append(loss)
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        weights = weights - step
        if np.max(np.abs(step)) < tolerance:
            break
    return _named(columns, weights[1:], weights[0]), losses


def cells_of(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """Rows with equal regressors as one: their values, how many they are and the sum of the target."""
    known = df.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)], F.col(y).cast("double").alias("y")).dropna()
    return known.groupBy(*[f"x{k}" for k in range(len(columns))]).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s"))


def logistic_descent(df: DataFrame, columns: Sequence[str], y: str, alpha: float, epochs: int, most_cells: int = LOCAL_CELLS) -> tuple[dict[str, float], list[float]]:
    """Plain gradient steps on the summed log loss, from zero weights, and the loss before each step.

    The gradient needs of the rows with equal regressors only their number and
    the sum of their targets, so the table is first reduced to such cells. Up to
    ``most_cells`` of them are brought to the driver, and all steps cost one pass
    over the table. With more, the cells are written and each step is a job over them.
    """
    k = len(columns) + 1
    cells = checkpoint(cells_of(df, columns, y))
    if cells.limit(most_cells + 1).count() <= most_cells:
        parts = [cells.orderBy(*cells.columns[:-2]).toPandas().to_numpy(dtype=float)]
    else:
        parts = None

    def sums(rows: np.ndarray) -> np.ndarray:
        x, n, s = np.column_stack([np.ones(len(rows)), rows[:, :k - 1]]), rows[:, k - 1], rows[:, k]
        z = x @ weights
        p = 1.0 / (1.0 + np.exp(-np.abs(z)))
        loss = n * np.logaddexp(0.0, z) - s * z
        return np.concatenate([x.T @ (n * np.where(z >= 0, p, 1.0 - p) - s), [loss.sum()]])

    weights, losses = np.zeros(k), []
    for _ in range(epochs):
        flat = sums(parts[0]) if parts else _summed_matrices(cells, sums, k + 1)
        losses.append(float(flat[-1]))
        weights = weights - alpha * flat[:k]
    return _named(columns, weights[1:], weights[0]), losses


def probability(coefficients: Mapping[str, float]) -> Column:
    return 1.0 / (1.0 + F.exp(-prediction(coefficients)))
