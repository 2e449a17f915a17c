"""Upper tails of the F, chi-square and binomial distributions, in plain Python."""

from __future__ import annotations

import math

_TINY = 1e-300


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by series below a + 1 and continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / ((step * d + b) or _TINY)
        c = b + step / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def beta_lower(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(1 - x, b, a)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or _TINY)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or _TINY)
            c = 1 + top / c or _TINY
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return scale * h


def f_tail(value: float, between: float, within: float) -> float:
    if math.isnan(value):
        return math.nan
    return 0.0 if math.isinf(value) else beta_lower(within / (within + between * value), within / 2, between / 2)


def chi2_tail(value: float, degrees: float) -> float:
    return gamma_upper(degrees / 2, value / 2) if degrees > 0 else math.nan


def binomial_tails(hits: int, trials: int) -> tuple[float, float]:
    """P(H >= hits) and P(H <= hits) of fair coin tosses."""
    weights = [math.comb(trials, k) for k in range(trials + 1)]
    return sum(weights[hits:]) / 2**trials, sum(weights[: hits + 1]) / 2**trials
