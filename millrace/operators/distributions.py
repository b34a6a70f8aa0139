"""Tails of the distributions that tests need, by series and continued fractions."""

from __future__ import annotations

import math

TINY, CLOSE, MOST = 1e-300, 1e-15, 100_000


def _fraction(terms) -> float:
    """A continued fraction 1 / (b0 + a1 / (b1 + a2 / (b2 + ...))) from pairs (a, b), multiplied out from the front."""
    value, c, d = TINY, TINY, 0.0
    for a, b in terms:
        d, c = b + a * d, b + a / c
        d, c = 1.0 / (d or TINY), c or TINY
        value *= c * d
        if abs(c * d - 1.0) < CLOSE:
            break
    return value


def upper_gamma(shape: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(shape, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:  # the lower part converges faster as a series
        term = total = 1.0 / shape
        for k in range(1, MOST):
            term *= x / (shape + k)
            total += term
            if term < total * CLOSE:
                break
        return 1.0 - scale * total
    return scale * _fraction((1.0 if k == 0 else k * (shape - k), x + 2 * k + 1 - shape) for k in range(MOST))


def lower_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - lower_beta(b, a, 1.0 - x)

    def terms():
        yield 1.0, 1.0
        for k in range(MOST):
            yield -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)), 1.0
            yield (k + 1) * (b - k - 1) * x / ((a + 2 * k + 1) * (a + 2 * k + 2)), 1.0

    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return scale / a * _fraction(terms())


def chi_square_tail(x: float, degrees: float) -> float:
    """Probability of a value above x."""
    return upper_gamma(degrees / 2, x / 2)


def student_tails(t: float, degrees: float) -> float:
    """Probability of a value farther from zero than t, on either side."""
    return f_tail(t * t, 1.0, degrees)


def f_tail(x: float, first: float, second: float) -> float:
    """Probability of a ratio of variances above x."""
    if first * x < second:  # else the complement would be rounded to one
        return 1.0 - lower_beta(first / 2, second / 2, first * x / (second + first * x))
    return lower_beta(second / 2, first / 2, second / (second + first * x))
