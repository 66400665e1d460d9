"""Normal and Student-t tail probabilities (standard formulas)."""

from __future__ import annotations

import math


def normal_two_sided(statistic: float) -> float:
    return math.erfc(abs(statistic) / math.sqrt(2.0))


def normal_quantile(probability: float) -> float:
    return _bisect(lambda x: 0.5 * math.erfc(-x / math.sqrt(2.0)), probability)


def _beta_continued_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the continued fraction of the incomplete beta."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for numerator in (even, odd):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_continued_fraction(a, b, x) / a
    return 1.0 - front * _beta_continued_fraction(b, a, 1.0 - x) / b


def student_two_sided(statistic: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + statistic * statistic))


def student_quantile(probability: float, df: float) -> float:
    def cdf(x: float) -> float:
        tail = 0.5 * student_two_sided(x, df)
        return 1.0 - tail if x >= 0 else tail

    return _bisect(cdf, probability)


def _bisect(cdf, probability: float) -> float:
    low, high = -1e3, 1e3
    while cdf(high) < probability and high < 1e12:
        low, high = high, high * 10
    while cdf(low) > probability and low > -1e12:
        low, high = low * 10, low
    for _ in range(200):
        middle = 0.5 * (low + high)
        if cdf(middle) < probability:
            low = middle
        else:
            high = middle
    return 0.5 * (low + high)
