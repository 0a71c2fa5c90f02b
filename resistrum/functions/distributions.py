"""Distribution functions and quantiles as columns: series and continued fractions folded over a sequence, without Python.

Each fold has a fixed number of steps, stated where it is used; results are within 1e-9 of the true values. A null or impossible
argument gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos' coefficients (g = 7) of the gamma function.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
_TINY = 1e-300


def _double(x: Column) -> Column:
    return x.cast("double")


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of a positive number; below 1/2 by reflection."""

    def above(z: Column) -> Column:
        z = z - 1
        total = F.lit(_LANCZOS[0])
        for k, c in enumerate(_LANCZOS[1:], 1):
            total = total + c / (z + k)
        t = z + 7.5
        return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(total)

    x = _double(x)
    return F.when(x >= 0.5, above(x)).when(x > 0, F.log(F.lit(math.pi) / F.sin(math.pi * x)) - above(1 - x))


def normal_density(x: Column) -> Column:
    x = _double(x)
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _fold(steps: int, start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]], end: Callable[[Column], Column]) -> Column:
    names = list(start)
    pack = lambda d: F.struct(*[_double(d[n]).alias(n) for n in names])
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), pack(start), lambda s, k: pack(step(s, k)), end)


def normal_probability(x: Column) -> Column:
    """P(X <= x): Marsaglia's series near 0 (80 steps to 1e-15 up to 5), beyond it a continued fraction (40 levels)."""
    x = _double(x)
    a = F.abs(x)
    series = _fold(80, {"term": a, "sum": a}, lambda s, k: {"term": s["term"] * a * a / (2 * k + 1), "sum": s["sum"] + s["term"] * a * a / (2 * k + 1)}, lambda s: s["sum"])
    tail = _fold(40, {"f": a}, lambda s, k: {"f": a + (41 - k) / s["f"]}, lambda s: s["f"])
    upper = F.when(a <= 5, 0.5 - series * normal_density(a)).otherwise(normal_density(a) / tail)
    return F.when(F.isnan(x), None).when(x >= 0, 1 - upper).otherwise(upper)


def normal_quantile(p: Column) -> Column:
    """The x of which normal_probability is p, by 12 Newton steps in ln p from a rational start (Abramowitz and Stegun 26.2.23)."""
    p = _double(p)
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(q))
    start = -(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t))

    def newton(s: Column, _: Column) -> dict[str, Column]:
        value = normal_probability(s["x"])
        return {"x": F.transform(F.array(value), lambda v: s["x"] - (F.log(v) - F.log(q)) * v / normal_density(s["x"]))[0]}

    low = _fold(12, {"x": start}, newton, lambda s: s["x"])
    return F.when(p == 0.5, 0.0).when((p > 0) & (p < 1), F.when(p < 0.5, low).otherwise(-low)).when(p == 0, float("-inf")).when(p == 1, float("inf"))


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function by Lentz's continued fraction (200 levels; on the side where it converges fast)."""
    a, b, x = _double(a), _double(b), _double(x)

    def fraction(a: Column, b: Column, x: Column) -> Column:
        safe = lambda v: F.when(F.abs(v) < _TINY, _TINY).otherwise(v)

        def level(s: Column, k: Column) -> dict[str, Column]:
            even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
            odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
            d1, c1 = 1 / safe(1 + even * s["d"]), safe(1 + even / s["c"])
            d2, c2 = 1 / safe(1 + odd * d1), safe(1 + odd / c1)
            return {"c": c2, "d": d2, "h": s["h"] * d1 * c1 * d2 * c2}

        d0 = 1 / safe(1 - (a + b) * x / (a + 1))
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a
        return front * _fold(200, {"c": F.lit(1.0), "d": d0, "h": d0}, level, lambda s: s["h"])

    inside = F.when(x < (a + 1) / (a + b + 2), fraction(a, b, x)).otherwise(1 - fraction(b, a, 1 - x))
    return F.when((a <= 0) | (b <= 0) | (x < 0) | (x > 1), None).when(x == 0, 0.0).when(x == 1, 1.0).otherwise(inside)


def t_probability(t: Column, df: Column) -> Column:
    """P(T <= t) of Student's distribution."""
    t, df = _double(t), _double(df)
    tail = incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t)) / 2
    return F.when(t >= 0, 1 - tail).otherwise(tail)


def t_two_sided(t: Column, df: Column) -> Column:
    t, df = _double(t), _double(df)
    return incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))


def _summed(last: Column, log_first: Column, log_ratio: Callable[[Column], Column], p: Column) -> Column:
    """Over the counts 0 to last: their probability (sum), and the first count (at) up to which it is at least p.

    A step goes from the logarithm of a count's probability to that of the next, so that nothing underflows; `last` steps are taken.
    """
    zero = F.exp(log_first)
    start = F.struct(log_first.alias("log"), zero.alias("sum"), F.when(zero >= p, 0.0).alias("at"))

    def step(s: Column, k: Column) -> Column:
        moved = F.transform(F.array(s["log"] + log_ratio(_double(k))), lambda g: F.struct(g.alias("g"), (s["sum"] + F.exp(g)).alias("t")))[0]
        return F.transform(F.array(moved), lambda m: F.struct(m["g"].alias("log"), m["t"].alias("sum"), F.coalesce(s["at"], F.when(m["t"] >= p, _double(k))).alias("at")))[0]

    return F.aggregate(F.when(last >= 1, F.sequence(F.lit(1), last.cast("int"))).otherwise(F.array().cast("array<int>")), start, step)


def _poisson(last: Column, mean: Column, p: Column) -> Column:
    return _summed(last, -mean, lambda k: F.log(mean) - F.log(k), p)


def _negative_binomial(last: Column, size: Column, mean: Column, p: Column) -> Column:
    return _summed(last, size * F.log(size / (size + mean)), lambda k: F.log((k - 1 + size) / k) + F.log(mean / (size + mean)), p)


def poisson_probability(k: Column, mean: Column) -> Column:
    """P(N <= k) of a Poisson count, as the sum of k + 1 probabilities."""
    k, mean = F.floor(_double(k)), _double(mean)
    return F.when((mean < 0) | mean.isNull() | k.isNull(), None).when(k < 0, 0.0).when(mean == 0, 1.0).otherwise(F.least(F.lit(1.0), _poisson(k, mean, F.lit(2.0))["sum"]))


def negative_binomial_probability(k: Column, size: Column, mean: Column) -> Column:
    """P(N <= k) of a negative binomial count with variance mean + mean ** 2 / size."""
    k, size, mean = F.floor(_double(k)), _double(size), _double(mean)
    return F.when((size <= 0) | (mean < 0) | k.isNull(), None).when(k < 0, 0.0).when(mean == 0, 1.0).otherwise(F.least(F.lit(1.0), _negative_binomial(k, size, mean, F.lit(2.0))["sum"]))


def _last(mean: Column, sd: Column, p: Column) -> Column:
    """A count up to which the probability is at least p: by Cantelli's inequality, at most sqrt(p / (1 - p)) deviations above the mean, and 60 for p up to 1 - 1e-8."""
    return F.ceil(mean + F.least(F.lit(60.0), F.sqrt(F.try_divide(p, 1 - p)) + 1) * sd + 60)


def poisson_quantile(p: Column, mean: Column) -> Column:
    """The least count whose probability is at least p, for p up to 1 - 1e-8."""
    p, mean = _double(p), _double(mean)
    return F.when((p > 0) & (p < 1), F.when(mean == 0, 0).when(mean > 0, _poisson(_last(mean, F.sqrt(mean), p), mean, p - 1e-12)["at"].cast("long")))


def negative_binomial_quantile(p: Column, size: Column, mean: Column) -> Column:
    p, size, mean = _double(p), _double(size), _double(mean)
    return F.when((p > 0) & (p < 1), F.when(mean == 0, 0).when((mean > 0) & (size > 0), _negative_binomial(_last(mean, F.sqrt(mean + mean * mean / size), p), size, mean, p - 1e-12)["at"].cast("long")))
