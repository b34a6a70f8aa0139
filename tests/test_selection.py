"""Places in a matrix of differences, against the sorted differences."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.operators import selection as sl
from millrace.operators import statistics as st


def test_bits_keep_the_order():
    values = [-np.inf, -3.5, -1e-300, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 7e200, np.inf]
    bits = [sl.ordered_bits(v) for v in values]
    assert bits == sorted(bits) and [sl.from_bits(b) for b in bits] == values


def frame(spark, a, b):
    values = sorted(set(a.tolist()) | set(b.tolist()))
    return spark.createDataFrame([(v, int((a == v).sum()), int((b == v).sum())) for v in values], "v double, n1 long, n2 long").repartition(4)


@pytest.mark.parametrize("block, listed", [(20_000, 100_000), (7, 50)])
def test_places_equal_the_sorted_differences(spark, monkeypatch, block, listed):
    monkeypatch.setattr(sl, "BLOCK", block)
    monkeypatch.setattr(sl, "LISTED", listed)
    draw = np.random.default_rng(1)
    for a, b in ((draw.normal(size=90).round(2), draw.normal(size=70).round(2)), (draw.integers(0, 5, 300) / 10, draw.integers(0, 4, 200) / 10), (np.array([3.0]), np.array([0.1])),
                 (np.repeat(0.3, 40), np.repeat(0.1, 50))):
        every = np.sort((a[:, None] - b[None, :]).ravel())
        places = [1, len(every) // 3 + 1, len(every) // 2 + 1, len(every)]
        matrix = sl.DifferenceMatrix(frame(spark, a, b))
        assert matrix.pairs == len(every) and matrix.smallest(places) == [every[p - 1] for p in places]


def test_shift_of_eighty_and_of_eight_thousand_values(spark):
    draw = np.random.default_rng(2)
    for distinct in (80, 8000):
        a, b = draw.permutation(distinct)[: distinct // 2] * 0.01, draw.permutation(distinct)[: distinct // 2] * 0.01 - 3
        rows = [("x", float(v)) for v in a] + [("y", float(v)) for v in b] + [("x", None), ("z", 1.0), ("y", float("nan"))]
        df = spark.createDataFrame(rows, "g string, v double")
        every = np.sort((a[:, None] - b[None, :]).ravel())
        n = len(every)
        half = 1.959963984540054 * np.sqrt(n * (len(a) + len(b) + 1) / 12)
        want = (float((every[(n + 1) // 2 - 1] + every[n // 2]) / 2), every[max(1, int(n / 2 - half)) - 1], every[min(n, int(np.ceil(n / 2 + half)) + 1) - 1])
        assert st.location_shift(df, "g", "v", "x", "y") == pytest.approx(want, abs=0)
    assert st.location_shift(df.where("g = 'x'"), "g", "v", "x", "y") == (None, None, None)
