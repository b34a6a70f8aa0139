"""Tails of distributions, the tests built on them, descent on cells and aliased terms."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import distributions as ds
from millrace.operators import regression as rg
from millrace.operators import statistics as st


def test_tails_in_closed_form():
    for x in (1e-8, 0.3, 1.0, 4.0, 30.0, 200.0):
        assert ds.chi_square_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
        assert ds.chi_square_tail(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
        assert ds.chi_square_tail(x, 8) == pytest.approx(math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(4)), rel=1e-9)
        assert ds.student_tails(x, 1) == pytest.approx(1 - 2 / math.pi * math.atan(x), abs=1e-12)
        assert ds.f_tail(x * x, 1, 7) == pytest.approx(ds.student_tails(x, 7), rel=1e-9)
        for degrees in (2, 5, 40, 1001):
            assert ds.student_tails(x, degrees) == pytest.approx(st.student_two_sided(x, degrees), abs=1e-11)
    assert ds.student_tails(2.0, 2_000_000) == pytest.approx(math.erfc(math.sqrt(2)), abs=1e-6)
    assert ds.chi_square_tail(0, 3) == 1.0 and ds.student_tails(0.0, 5) == 1.0


def test_p_values_of_degenerate_tables(spark):
    perfect = spark.createDataFrame([(k, 2 * k + 1) for k in range(9)], "x int, y int")
    row = st.spearman_test(perfect, "x", "y").first()
    assert row.rho == 1.0 and math.isinf(row.t) and row.p_value == 0.0
    assert st.spearman_test(perfect.limit(2), "x", "y").first().p_value is None
    assert st.chi_square_test(perfect.withColumn("x", F.lit(1)), "x", "y").first().p_value is None


def test_descent_on_the_driver_and_on_executors(spark):
    draw = np.random.default_rng(4)
    x, y = draw.integers(-3, 4, 400) / 2, draw.integers(0, 2, 400)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)] + [(None, 1), (1.0, None)], "x double, y int").repartition(3)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
        w = w - 0.01 * np.array([(p - y).sum(), ((p - y) * x).sum()])
    for most in (rg.LOCAL_CELLS, 3):
        found, losses = rg.logistic_descent(df, ["x"], "y", 0.01, 30, most)
        assert [found["intercept"], found["x"]] == pytest.approx(w, abs=1e-9) and losses[-1] < losses[0]
    long, _ = rg.logistic_descent(df, ["x"], "y", 0.002, 10_000)
    newton, _ = rg.logistic_newton(df, ["x"], "y")
    assert long == pytest.approx(newton, abs=1e-6)


def test_aliased_levels_come_out_null(spark):
    draw = np.random.default_rng(5)
    rows = [(float(draw.normal()), "abc"[k % 3], "uvw"[k % 3], float(draw.normal())) for k in range(90)]
    df = spark.createDataFrame(rows, "x double, g string, h string, y double")
    steps = [("one", {"x": F.col("x"), **rg.dummies("g", ["a", "b", "c"])}), ("two", rg.dummies("h", ["u", "v", "w"])), ("three", {"x_squared": F.col("x") * F.col("x")})]
    got = {(r.model, r.term): r for r in rg.nested_models(df, "y", steps, "HC1").collect()}
    for term in ("x", "g[b]", "g[c]", "intercept"):
        assert (got["one", term].estimate, got["one", term].std_error) == (got["two", term].estimate, got["two", term].std_error)
    assert all(got[m, f"h[{level}]"].estimate is None for m in ("two", "three") for level in "vw")
    x, g, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
    full = np.column_stack([np.ones(90), x, g == "b", g == "c", x * x]).astype(float)
    want = np.linalg.lstsq(full, y, rcond=None)[0]
    assert [got["three", t].estimate for t in ("intercept", "x", "g[b]", "g[c]", "x_squared")] == pytest.approx(want, abs=1e-6)
