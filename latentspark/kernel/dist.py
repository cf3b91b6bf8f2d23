"""Normal and Student t probabilities without scipy."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return -math.inf if p <= 0 else math.inf if p >= 1 else NORMAL.inv_cdf(p)


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.nan if math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def cramer_von_mises_from_statistic(w: float, n: float) -> float:
    """P-value of the one-sample statistic: the limiting distribution's series in Bessel functions and
    the published term of order 1 / n (Csorgo and Faraway, 1996)."""
    if w <= 1 / (12 * n):
        return 1.0
    if w >= n / 3:
        return 0.0
    below = _limit_cdf(w) * (1 + 1 / (12 * n)) - _first_order(w) / n
    return min(1.0, max(0.0, 1 - below))


def _limit_cdf(w: float) -> float:
    total = 0.0
    for k in range(60):
        q = (4 * k + 1) ** 2 / (16 * w)
        if q > 350:
            break
        total += math.exp(math.lgamma(k + 0.5) - math.lgamma(k + 1)) * math.sqrt(4 * k + 1) * math.exp(-2 * q) * _bessel(0.25, q)
    return total / (math.pi**1.5 * math.sqrt(w))


def _first_order(w: float) -> float:
    """The term of order 1 / n (its sign turned): a series whose summands weigh two functions at 4k + 1,
    4k + 3 and 4k + 5 over twice the root of the statistic."""
    root = 2 * math.sqrt(w)

    def second(m: int) -> float:
        y = m / root
        z = y * y / 4
        return math.exp(-2 * z) * (y / 2) ** 1.5 * (_bessel(0.25, z) + _bessel(0.75, z)) / math.sqrt(math.pi) if z < 350 else 0.0

    def third(m: int) -> float:
        y = m / root
        z = y * y / 4
        if z >= 350:
            return 0.0
        return math.exp(-2 * z) * (y / 2) ** 2.5 * (2 * _bessel(0.25, z) + 3 * _bessel(0.75, z) - _bessel(1.25, z)) / math.sqrt(math.pi)

    total = 0.0
    for k in range(60):
        half = math.exp(math.lgamma(k + 0.5) - math.lgamma(k + 1))  # ratio of gamma functions
        by_second = (2 * k + 1) * half * (second(4 * k + 3) / 9 + 7 * (second(4 * k + 1) + second(4 * k + 5)) / 144) / w**0.75
        by_third = half * (third(4 * k + 1) / 72 + (2 * k + 3) * (k + 0.5) * third(4 * k + 5) / 6) / w**1.25
        total += by_second + by_third
        if k and by_second + by_third < 1e-15 * abs(total):
            break
    return total / math.pi


def _bessel(order: float, x: float) -> float:
    """exp(x) K_order(x) by the integral of exp(-x (cosh t - 1)) cosh(order t)."""
    h, total, t = 0.005, 0.5, 0.0
    while True:
        t += h
        e = x * (math.cosh(t) - 1)
        if e > 50:
            return total * h
        total += math.exp(-e) * math.cosh(order * t)
