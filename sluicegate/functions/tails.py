"""p-values as plain column expressions, meant for tables of one row per feature."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KS_TERMS = 100
#: Half degrees of freedom up to which the tail is summed, and the terms that any such sum needs.
DIRECT, TERMS = 200, 400


def kolmogorov_p(distance: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value; 1 where the distance is 0."""
    lam2 = distance * distance * (n * m / (n + m))

    def term(k: Column) -> Column:
        sign = F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        return sign * F.exp(-2.0 * k * k * lam2)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0), lambda acc, k: acc + term(k))
    # Below this the alternating series has not settled, and the true value is 1 to 12 digits.
    return F.when(lam2 < 0.04, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def log_gamma_half(twice: Column) -> Column:
    """ln Γ(twice/2 + 1) for a whole number ``twice`` up to ``2 * DIRECT``."""
    steps = F.floor(twice / 2).cast("int")
    half = twice / 2.0
    start = F.when(twice % 2 == 1, F.lit(0.5 * math.log(math.pi))).otherwise(F.lit(0.0))
    terms = F.when(twice % 2 == 1, F.sequence(F.lit(0), steps)).otherwise(
        F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))
    )
    return F.aggregate(terms, start, lambda acc, j: acc + F.log(half - j))


def _lower_share(a: Column, x: Column, log_scale: Column) -> Column:
    """The regularised lower incomplete gamma function by its series, for x below about a + 1."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * x / (a + k)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["total"])
    return total * F.exp(log_scale)


def _upper_share(a: Column, x: Column, log_scale: Column) -> Column:
    """The regularised upper incomplete gamma function by its continued fraction, for x above about a + 1."""
    first = x + 1.0 - a
    start = F.struct((1.0 / first).alias("d"), F.lit(1e300).alias("c"), (1.0 / first).alias("h"))

    def step(acc: Column, k: Column) -> Column:
        an, b = -k * (k - a), first + 2.0 * k
        d, c = 1.0 / (b + an * acc["d"]), b + an / acc["c"]
        return F.struct(d.alias("d"), c.alias("c"), (acc["h"] * d * c).alias("h"))

    fraction = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["h"])
    return fraction * F.exp(log_scale) * a


def _uniform_tail(a: Column, x: Column) -> Column:
    """The upper tail for large ``a`` by the expansion that holds for all ``x``; its error is below 1e-8 from DIRECT on."""
    mu = x / a - 1.0
    eta = F.signum(mu) * F.sqrt(F.greatest(F.lit(0.0), 2.0 * (mu - F.log1p(mu))))
    z2 = a * eta * eta / 2.0
    near = F.abs(eta) < 0.05
    c0 = F.when(near, -1 / 3 + eta / 12.0 - eta * eta * (2 / 135) + F.pow(eta, 3) / 864.0).otherwise(1.0 / mu - 1.0 / eta)
    c1 = F.when(near, -1 / 540 - eta / 288.0 + eta * eta / 378.0).otherwise(
        1.0 / F.pow(eta, 3) - 1.0 / F.pow(mu, 3) - 1.0 / (mu * mu) - 1.0 / (12.0 * mu)
    )
    half = _gamma_tail(F.lit(0.5), z2, F.lit(1)) / 2.0
    body = F.when(eta >= 0, half).otherwise(1.0 - half)
    return body + F.exp(-z2) / F.sqrt(2.0 * math.pi * a) * (c0 + c1 / a)


def _gamma_tail(a: Column, x: Column, twice: Column) -> Column:
    scale = -x + a * F.log(x) - log_gamma_half(twice)
    low = 1.0 - _lower_share(a, x, scale)
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1.0, low).otherwise(_upper_share(a, x, scale))


def chi_square_p(statistic: Column, df: Column) -> Column:
    """Upper chi-square tail for whole ``df``, by a fixed number of terms whatever ``df`` is.

    Far in the tail, where the result is below 1e-30, it is 0.
    """
    a = df / 2.0
    x = statistic / 2.0
    far = x > a + 60.0 + 20.0 * F.sqrt(a)
    small = F.least(df, F.lit(2 * DIRECT))
    direct = _gamma_tail(small / 2.0, x, small)
    tail = F.when(a <= DIRECT, direct).otherwise(_uniform_tail(a, x))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail))
    return F.when((df <= 0) | (x <= 0), F.lit(1.0)).when(far, F.lit(0.0)).otherwise(bounded)


def two_sided_normal_p(z: Column) -> Column:
    """P(|Z| >= |z|): the one-degree chi-square tail of z²."""
    return chi_square_p(z * z, F.lit(1))
