"""Closed-form statistics as columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The quantile of the 95 % Wilson interval, and of other levels.
Z95 = 1.959963984540054
Z_LEVELS = {0.80: 1.281552, 0.90: 1.644854, 0.95: 1.959964, 0.975: 2.241403, 0.99: 2.575829}


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; null if whole is 0."""
    return F.when(whole > 0, F.lit(100.0) * part / whole)


def z_of(level: float) -> float:
    """The quantile of the nearest known level."""
    return Z_LEVELS[min(Z_LEVELS, key=lambda x: abs(x - level))]


def wilson(x: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Low and high end of the Wilson interval of x of n; (0, 0) if n is 0."""
    x, n = x.cast("double"), n.cast("double")
    p, zz = x / n, z * z
    centre, spread = p + zz / (2 * n), z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)
    low, high = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), e / (1 + zz / n))) for e in (centre - spread, centre + spread))
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def xlogy(x: Column, y: Column) -> Column:
    """x * ln(y), and 0 where x is 0."""
    return F.when(x == 0, 0.0).otherwise(x * F.log(y))


def llr_space_time(observed: Column, expected: Column, total: Column) -> Column:
    o, e, n = observed.cast("double"), expected.cast("double"), total.cast("double")
    return F.when((o > e) & (e > 0) & (n > o) & (n > e), o * F.log(o / e) + (n - o) * F.log((n - o) / (n - e))).otherwise(0.0)


@F.pandas_udf(DoubleType())
def _bernoulli_ratio(cases: pd.Series, tested: pd.Series, all_cases: pd.Series, all_tested: pd.Series) -> pd.Series:
    """The ratio's terms in the order in which its SQL adds them, with the C library's logarithm.

    Terms are as large as the counts and nearly cancel: of millions tested, another order or Spark's logarithm (which may be off by
    another last digit) moves the sixth decimal of some ratios.
    """

    def term(k: float, m: float) -> float:
        return k * math.log(k / m) if k > 0 else 0.0

    def ratio(c: float, n: float, cc: float, nn: float) -> float:
        if not (0 < n < nn and 0 < cc < nn and c / n > (cc - c) / (nn - n)):
            return 0.0
        return term(c, n) + term(n - c, n) + term(cc - c, nn - n) + term(nn - n - cc + c, nn - n) - term(cc, nn) - term(nn - cc, nn)

    return pd.Series([ratio(*x) for x in zip(cases, tested, all_cases, all_tested, strict=True)], dtype="float64")


def llr_bernoulli(cases: Column, tested: Column, all_cases: Column, all_tested: Column) -> Column:
    """Log likelihood ratio of a higher proportion inside than outside; 0 for all others."""
    return _bernoulli_ratio(*(x.cast("double") for x in (cases, tested, all_cases, all_tested)))


def llr_poisson(cases: Column, population: Column, all_cases: Column, all_population: Column) -> Column:
    c, cc = cases.cast("double"), all_cases.cast("double")
    e = cc * population / all_population
    return F.when((c > e) & (e > 0) & (cc - e > 0), xlogy(c, c / e) + xlogy(cc - c, (cc - c) / (cc - e))).otherwise(0.0)


def sidak(p: Column, tests: int) -> Column:
    return 1 - F.pow(1 - p, F.lit(tests))


def cusum_reference(baseline: Column, shift: float) -> Column:
    """Between a Poisson mean and one shifted by `shift` of its square root: the allowance per period."""
    raised = baseline + shift * F.sqrt(baseline)
    return (raised - baseline) / F.log(raised / baseline)


def risk_rating(likelihood: Column, impact: Column, exposure: Column, spread: Column, control_gap: Column) -> tuple[Column, Column]:
    """Weighted mean of components clamped to 0..5, and its rating; null if any is missing."""
    parts = [(likelihood, 0.25), (impact, 0.30), (exposure, 0.20), (spread, 0.15), (control_gap, 0.10)]
    score = F.lit(0.0)
    for value, weight in parts:
        score = score + F.least(F.lit(5.0), F.greatest(F.lit(0.0), value.cast("double"))) * weight
    missing = F.lit(False)
    for value, _ in parts:
        missing = missing | value.isNull()
    score = F.when(~missing, score)
    return score, F.when(score < 1.5, "low").when(score < 2.5, "moderate").when(score < 3.5, "high").when(score.isNotNull(), "critical")
