"""Outbreak detection: dense series, control charts, scan windows with their null distribution, seasonal regression."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resistrum.functions import distributions
from resistrum.functions.stats import llr_bernoulli, llr_space_time
from resistrum.sources.shared import written

POOLED = "All locations"
#: Parts over which the fitted weeks of all series are dealt.
WEEK_PARTS = 64


def daily(events: DataFrame) -> DataFrame:
    """location, signal, day, cases on each day of the study, with zeros, and the same over all locations.

    Events are read once; all else is made of their counts by location, signal and day.
    """
    counts = written(events.groupBy("location", "signal", "day").agg(F.count("*").alias("cases")), "counts")
    first, last = counts.agg(F.min("day"), F.max("day")).first()
    pooled = counts.groupBy("signal", "day").agg(F.sum("cases").alias("cases")).select(F.lit(POOLED).alias("location"), "signal", "day", "cases")
    both = counts.union(pooled)
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")
    return both.select("location", "signal").distinct().select("location", "signal", days).join(both, ["location", "signal", "day"], "left").select("location", "signal", "day", F.coalesce("cases", F.lit(0)).alias("cases"))


def periods(series: DataFrame, days: int = 7) -> DataFrame:
    """Sums over periods of `days` that end with the series; a first period that isn't whole is dropped."""
    series_key = Window.partitionBy("location", "signal")
    back = F.datediff(F.max("day").over(series_key), "day")
    placed = series.withColumn("_back", F.floor(back / days).cast("int"))
    found = placed.groupBy("location", "signal", "_back").agg(F.sum("cases").cast("long").alias("cases"), F.max("day").alias("period_end"), F.count("*").alias("_n")).where(F.col("_n") == days)
    return found.select("location", "signal", "period_end", "cases")


def cusum(series: DataFrame, baseline: float, allowance: float) -> DataFrame:
    """max(0, S + x - baseline - allowance) along each series, as a running sum less its running minimum."""
    order = Window.partitionBy("location", "signal").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    total = series.withColumn("_p", F.sum(F.col("cases") - F.lit(baseline + allowance)).over(order))
    return total.withColumn("cusum", F.col("_p") - F.least(F.lit(0.0), F.min("_p").over(order))).drop("_p")


def ewma(series: DataFrame, weight: float = 0.2) -> DataFrame:
    """The exponentially weighted mean along each series; the first value starts it. Folds one series' sorted values."""
    listed = series.groupBy("location", "signal").agg(F.array_sort(F.collect_list(F.struct("day", "cases"))).alias("_all"))
    start = F.array().cast("array<struct<day: date, cases: bigint, ewma: double>>")
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["day"].alias("day"), x["cases"].alias("cases"), F.when(F.size(acc) == 0, x["cases"].cast("double")).otherwise(weight * x["cases"] + (1 - weight) * F.element_at(acc, -1)["ewma"]).alias("ewma"))))
    return listed.select("location", "signal", F.explode(F.aggregate("_all", start, step)).alias("_x")).select("location", "signal", "_x.day", "_x.cases", "_x.ewma")


def runs(chart: DataFrame, value: str, limit: float) -> DataFrame:
    """Each run of days above the limit as one row: begin, end, days and peak."""
    order = Window.partitionBy("location", "signal").orderBy("day")
    above = chart.withColumn("_above", F.col(value) > limit)
    opened = above.withColumn("_new", (F.col("_above") & ~F.coalesce(F.lag("_above").over(order), F.lit(False))).cast("int"))
    numbered = opened.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_above")
    return numbered.groupBy("location", "signal", "_run").agg(F.min("day").alias("begin"), F.max("day").alias("end"), F.count("*").alias("days"), F.max(value).alias("peak")).drop("_run")


def recent_guard(series: DataFrame, n: int = 4, least: int = 5) -> DataFrame:
    """Whether the last n periods up to each one hold enough cases to be judged."""
    order = Window.partitionBy("location", "signal").orderBy("day").rowsBetween(1 - n, 0)
    return series.withColumn("recent", F.sum("cases").over(order).cast("long")).withColumn("enough", F.col("recent") >= least)


def prospective_windows(events: DataFrame, max_days: int = 14, least: int = 3, replicate: str | None = None) -> DataFrame:
    """Scan windows that end on the last day: signal, location, days, observed, expected and llr.

    Expected is summed over seven strata (days from the study's begin, modulo 7): the location's cases of the
    stratum, times the window's share of the signal's cases of it. Counts per window come from one grouping: a case
    counts in all lengths that reach back to its day.
    """
    own = [replicate] if replicate else []
    cells, expected, totals, longest = _margins(events, max_days, own)
    lengths = F.explode(F.sequence(F.col("_age"), F.lit(longest))).alias("days")
    observed = cells.where(F.col("_age") <= longest).select(*own, "signal", "location", "_n", lengths).groupBy(*own, "signal", "location", "days").agg(F.sum("_n").alias("observed")).where(F.col("observed") >= least)
    both = observed.join(expected, [*own, "signal", "location", "days"]).join(totals, [*own, "signal"])
    return both.withColumn("llr", llr_space_time(F.col("observed"), F.col("expected"), F.col("total")))


def _margins(events: DataFrame, max_days: int, own: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Cases by signal, location, stratum (_s) and age in days; expected cases of each window; totals; the longest window."""
    first, last = events.agg(F.min("day"), F.max("day")).first()
    if first is None:
        first = last = pd.Timestamp("1970-01-01").date()
    longest = max(1, min(max_days, ((last - first).days + 1) // 2))
    placed = events.withColumn("_s", F.datediff("day", F.lit(first)) % 7).withColumn("_age", F.datediff(F.lit(last), "day") + 1)
    cells = placed.groupBy(*own, "signal", "location", "_s", "_age").agg(F.count("*").alias("_n"))
    lengths = F.explode(F.sequence(F.col("_age"), F.lit(longest))).alias("days")
    by_stratum = cells.groupBy(*own, "signal", "_s").agg(F.sum("_n").alias("_total"))
    window = cells.where(F.col("_age") <= longest).select(*own, "signal", "_s", "_n", lengths).groupBy(*own, "signal", "_s", "days").agg(F.sum("_n").alias("_in_window"))
    at_location = cells.groupBy(*own, "signal", "location", "_s").agg(F.sum("_n").alias("_at"))
    share = window.join(by_stratum, [*own, "signal", "_s"])
    expected = at_location.join(share, [*own, "signal", "_s"]).groupBy(*own, "signal", "location", "days").agg(F.sum(F.col("_at") * F.col("_in_window") / F.col("_total")).alias("expected"))
    totals = by_stratum.groupBy(*own, "signal").agg(F.sum("_total").alias("total"))
    return cells, expected, totals, longest


def null_maxima(events: DataFrame, replicates: int, max_days: int = 14, least: int = 3, seed: int = 1, chunk: int = 50) -> DataFrame:
    """replicate and top, its highest ratio of all windows, with days shuffled within strata.

    A shuffle keeps each location's and each day's cases of a stratum, so expected cases stay and only the counts of
    cells are drawn: day by day from the multivariate hypergeometric distribution over what the locations have left.
    The work hangs on cells and replicates (chunk of them to a task's row), not on cases.
    """
    cells, expected, totals, longest = _margins(events, max_days, [])
    places = cells.groupBy("signal", "location", "_s").agg(F.sum("_n").alias("n")).groupBy("signal").agg(F.collect_list(F.struct("location", "_s", "n")).alias("places"))
    days = cells.where(F.col("_age") <= longest).groupBy("signal", "_s", "_age").agg(F.sum("_n").alias("n")).groupBy("signal").agg(F.collect_list(F.struct("_s", "_age", "n")).alias("days"))
    windows = expected.groupBy("signal").agg(F.collect_list(F.struct("location", "days", "expected")).alias("windows"))
    begins = F.explode(F.sequence(F.lit(1), F.lit(replicates), F.lit(chunk))).alias("begin")
    work = places.join(days, "signal").join(windows, "signal").join(totals, "signal").select("*", begins).repartition("signal", "begin")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                names = sorted({p["location"] for p in row.places})
                at = {name: k for k, name in enumerate(names)}
                left = np.zeros((7, len(names)), dtype=np.int64)
                for p in row.places:
                    left[p["_s"], at[p["location"]]] = p["n"]
                means = np.zeros((len(names), longest))
                for w in row.windows:
                    means[at[w["location"]], w["days"] - 1] = w["expected"]
                order = sorted((d["_s"], d["_age"], d["n"]) for d in row.days)
                tops = []
                for replicate in range(row.begin, min(row.begin + chunk, replicates + 1)):
                    rng = np.random.default_rng([seed, zlib.crc32(str(row.signal).encode()), replicate])
                    rest, seen = left.copy(), np.zeros((len(names), longest), dtype=np.int64)
                    for stratum, age, n in order:
                        drawn = rng.multivariate_hypergeometric(rest[stratum], n)
                        rest[stratum] -= drawn
                        seen[:, age - 1] += drawn
                    observed, total = seen.cumsum(axis=1).astype(float), float(row.total)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        outside = np.where(observed < total, (total - observed) * np.log((total - observed) / (total - means)), 0.0)
                        llr = np.where((observed >= least) & (means > 0) & (observed > means) & (observed < total), observed * np.log(observed / means) + outside, 0.0)
                    tops.append(llr.max(initial=0.0))
                yield pd.DataFrame({"replicate": range(row.begin, row.begin + len(tops)), "top": tops})

    return work.mapInPandas(run, "replicate int, top double").groupBy("replicate").agg(F.max("top").alias("top"))


def permuted(events: DataFrame, replicates: int, seed: int = 1) -> DataFrame:
    """events (event_id, signal, location, day) with days shuffled within strata, once for each replicate.

    Cases of a stratum are ranked by id and their days by a seeded hash; equal ranks meet. All of it is
    joins and windows within (replicate, signal, stratum), so replicates spread over the cluster.
    """
    first = events.agg(F.min("day")).first()[0]
    s = events.withColumn("_s", F.datediff("day", F.lit(first)) % 7).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    key = ["replicate", "signal", "_s"]
    places = s.select(*key, "location", F.row_number().over(Window.partitionBy(*key).orderBy("event_id")).alias("_k"))
    days = s.select(*key, "day", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(seed), "replicate", "event_id"), "event_id")).alias("_k"))
    return places.join(days, [*key, "_k"]).select("replicate", "signal", "location", "day")


def scan(events: DataFrame, replicates: int = 99, max_days: int = 14, least: int = 3, report: float = 0.05, most: int = 50) -> DataFrame:
    """The reported clusters: windows with p = (1 + maxima at least as high) / (replicates + 1), at most `most`, no two overlapping at a place.

    Windows of a place all end on the last day and so overlap; the one with the highest ratio stays.
    """
    found = prospective_windows(events, max_days, least)
    maxima = null_maxima(events, replicates, max_days, least)
    best = found.groupBy("signal", "location").agg(F.max(F.struct("llr", "observed", (-F.col("days")).alias("minus"), "expected")).alias("b"))
    rows = best.select("signal", "location", (-F.col("b.minus")).alias("days"), "b.observed", "b.expected", "b.llr").where("llr > 0")
    # one number for each replicate: a list bounded by their number
    tops = F.array_sort(F.collect_list("top"))
    ranked = rows.join(F.broadcast(maxima.agg(tops.alias("_tops"))))
    p = (1 + F.size(F.filter("_tops", lambda t: t >= F.col("llr") - 1e-12))) / F.lit(replicates + 1.0)
    return ranked.withColumn("p_value", p).drop("_tops").where(F.col("p_value") <= report).withColumn("recurrence_days", 1 / F.col("p_value")).orderBy(F.desc("llr"), F.desc("observed"), "signal", "location").limit(most)


def bernoulli_scan(denominators: DataFrame, least: int = 3, least_tested: int = 10) -> DataFrame:
    """The purely spatial scan of proportions: each location against all others, by organism and agent."""
    cells = denominators.groupBy("organism", "agent", "location").agg(F.sum("resistant").alias("observed"), F.sum("tested").alias("tested"))
    whole = cells.groupBy("organism", "agent").agg(F.sum("observed").alias("all_observed"), F.sum("tested").alias("all_tested"))
    both = cells.join(whole, ["organism", "agent"]).where((F.col("observed") >= least) & (F.col("tested") >= least_tested))
    return both.withColumn("llr", llr_bernoulli(F.col("observed"), F.col("tested"), F.col("all_observed"), F.col("all_tested"))).where("llr > 0")


def _two_sided(t: float, df: int) -> float:
    """The probability of a larger absolute value of Student's t, by its finite sums; 1 without degrees of freedom."""
    if df < 1:
        return 1.0
    angle = math.atan(abs(t) / math.sqrt(df))
    total, term = 0.0, math.cos(angle) if df % 2 else 1.0
    for k in range(df // 2):
        total += term
        term *= math.cos(angle) ** 2 * ((2 * k + 2) / (2 * k + 3) if df % 2 else (2 * k + 1) / (2 * k + 2))
    inside = (angle + math.sin(angle) * total) * 2 / math.pi if df % 2 else math.sin(angle) * total
    return max(0.0, 1.0 - inside)


def _fits(y: np.ndarray, x: np.ndarray, w: np.ndarray, trend: bool) -> dict[str, np.ndarray]:
    """Weighted log-linear Poisson fits of y on 1 and x, one to a row: coefficients, covariance without dispersion, means, hat values, dispersion.

    Fits go on together until each deviance stays; a row that has settled is left alone. Values of weight 0 take no part.
    """
    mu = y + 0.1
    eta, old, live = np.log(mu), np.full(len(y), np.inf), np.ones(len(y), dtype=bool)
    x = x if trend else np.zeros_like(x)

    def moments(k: np.ndarray) -> tuple[np.ndarray, ...]:
        s0, s1, s2 = k.sum(axis=1), (k * x).sum(axis=1), (k * x * x).sum(axis=1) if trend else np.ones(len(k))
        return s0, s1, s2, s0 * s2 - s1 * s1

    b0, b1 = np.zeros(len(y)), np.zeros(len(y))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(50):
            k, z = w * mu, eta + (y - mu) / mu
            s0, s1, s2, det = moments(k)
            t0, t1 = (k * z).sum(axis=1), (k * x * z).sum(axis=1)
            b0, b1 = np.where(live, (s2 * t0 - s1 * t1) / det, b0), np.where(live, (s0 * t1 - s1 * t0) / det if trend else 0.0, b1)
            eta = np.where(live[:, None], np.clip(b0[:, None] + b1[:, None] * x, -30, 30), eta)
            mu = np.exp(eta)
            deviance = 2 * (w * (np.where(y > 0, y * np.log(y / mu), 0.0) - (y - mu))).sum(axis=1)
            live &= ~(np.abs(deviance - old) <= 1e-10 * (np.abs(deviance) + 0.1))
            old = deviance
            if not live.any():
                break
        s0, s1, s2, det = moments(w * mu)
        c00, c01, c11 = s2 / det, -s1 / det, s0 / det
        n = (w > 0).sum(axis=1)
        df = n - (2 if trend else 1)
        hat = w * mu * (c00[:, None] + 2 * c01[:, None] * x + c11[:, None] * x * x)
        phi = np.where(df > 0, (w * (y - mu) ** 2 / mu).sum(axis=1) / np.maximum(df, 1), 1.0)
    return {"b0": b0, "b1": b1, "c00": c00, "c11": c11 if trend else np.zeros(len(y)), "mu": mu, "hat": hat, "phi": phi, "df": df, "good": np.isfinite(b0) & np.isfinite(b1) & (det > 1e-12)}


def _reweighted(y: np.ndarray, x: np.ndarray, w: np.ndarray, trend: bool) -> dict[str, np.ndarray]:
    """Fits in which residuals above 1 of a first one lose weight; residuals are on the scale that makes Poisson counts near normal."""
    first = _fits(y, x, w, trend)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.sqrt(np.maximum(first["phi"], 1)[:, None] * (1 - first["hat"]))
        r = np.where(spread > 0, 1.5 * (y ** (2 / 3) * first["mu"] ** (-1 / 6) - np.sqrt(first["mu"])) / spread, 0.0)
        light = w * np.where(r > 1, np.maximum(r, 1) ** -2.0, 1.0)
        light *= (w.sum(axis=1) / light.sum(axis=1))[:, None]
    second = _fits(y, x, np.nan_to_num(light), trend)
    return {k: np.where(second["good"] if v.ndim == 1 else second["good"][:, None], second[k], v) for k, v in first.items()}


def _farrington(own: pd.DataFrame, years: int, half: int, per_year: int, z: float, least: int = 10) -> pd.DataFrame:
    """Every week of a series that has at least 4 weeks of reference with cases; all weeks are fitted at once."""
    own = own.sort_values("day").reset_index(drop=True)
    y, n = own["cases"].to_numpy(dtype=float), len(own)
    none = pd.DataFrame(columns=["location", "signal", "day", "cases", "expected", "upper", "dispersion", "scale", "trend", "n_references", "enough"])
    if y.sum() < least:
        return none
    back = np.concatenate([np.arange(-half, half + 1) - per_year * k for k in range(years, 0, -1)])
    at = np.arange(n)[:, None] + back
    known = at >= 0
    ref = np.where(known, y[np.maximum(at, 0)], 0.0)
    tested = np.flatnonzero((known.sum(axis=1) >= 4) & (ref.sum(axis=1) > 0))
    if not len(tested):
        return none
    ref, w, x = ref[tested], known[tested].astype(float), np.broadcast_to(back / per_year, (len(tested), len(back)))
    level = _reweighted(ref, x, w, False)
    keep = np.zeros(len(tested), dtype=bool)
    if years >= 3:
        slope = _reweighted(ref, x, w, True)
        error = np.sqrt(np.maximum(0.0, slope["phi"] * slope["c11"]))
        # the trend's test takes the dispersion as it is, the bound one of at least 1
        p = np.array([_two_sided(b / e, int(d)) if e > 0 and d > 0 else 1.0 for b, e, d in zip(slope["b1"], error, slope["df"], strict=True)])
        keep = slope["good"] & (p < 0.05) & (np.exp(np.minimum(slope["b0"], 700.0)) <= ref.max(axis=1))
        level = {k: np.where(keep if v.ndim == 1 else keep[:, None], slope[k], v) for k, v in level.items()}
    phi, expected = np.maximum(level["phi"], 1.0), np.exp(level["b0"])
    scale = np.sqrt(4 / 9 * expected ** (1 / 3) * (phi + phi * level["c00"] * expected))
    upper = np.maximum(0.0, expected ** (2 / 3) + z * scale) ** 1.5
    recent = pd.Series(y).rolling(4, min_periods=1).sum().to_numpy()[tested]
    out = own.loc[tested, ["location", "signal", "day", "cases"]].assign(expected=expected, upper=upper, dispersion=phi, scale=scale, trend=keep, n_references=w.sum(axis=1).astype(int), enough=recent >= 5)
    return out[np.isfinite(expected) & (expected > 0)]


def farrington(series: DataFrame, years: int = 5, half: int = 3, per_year: int = 52, alpha: float = 0.005, bound: str = "power") -> DataFrame:
    """Quasi-Poisson regression on the same weeks of years before, reweighted once: expected, upper bound, probability of as many cases, score and alarm.

    The trend stays if it is significant at 0.05 over three years or more and predicts no more than the largest
    reference value. bound is that of the 2/3 power or 'negative-binomial', of the fitted mean and dispersion. An alarm is above the
    bound, with at least 5 cases in the last 4 weeks; quiet weeks are returned without one. Series hold a row for each
    week, those without cases too; one of fewer than 10 cases is not tested.
    """
    if bound not in ("power", "negative-binomial"):
        raise ValueError(bound)
    z = NormalDist().inv_cdf(1 - alpha)
    fit = lambda own: _farrington(own, years, half, per_year, z)
    fitted = series.groupBy("location", "signal").applyInPandas(fit, "location string, signal string, day date, cases long, expected double, upper double, dispersion double, scale double, trend boolean, n_references int, enough boolean")
    # few series come out of few tasks; the folds of the distributions are made for each week
    fitted = fitted.repartition(WEEK_PARTS, "location", "signal", "day")
    cases, mean, phi = F.col("cases"), F.col("expected"), F.col("dispersion")
    if bound == "power":
        over = 1 - distributions.normal_probability((F.pow(cases, F.lit(2 / 3)) - F.pow(mean, F.lit(2 / 3))) / F.col("scale"))
        found = fitted.withColumn("probability", over)
    else:
        size, p = mean / (phi - 1), F.lit(1 - alpha)
        high = F.when(phi > 1, distributions.negative_binomial_quantile(p, size, mean)).otherwise(distributions.poisson_quantile(p, mean))
        below = F.when(phi > 1, distributions.negative_binomial_probability(cases - 1, size, mean)).otherwise(distributions.poisson_probability(cases - 1, mean))
        found = fitted.withColumns({"upper": high.cast("double"), "probability": 1 - below})
    score = F.when(F.col("upper") > mean, (cases - mean) / (F.col("upper") - mean)).otherwise(0.0)
    return found.withColumn("score", score).withColumn("alarm", F.col("enough") & (F.col("score") > 1)).drop("scale", "enough")


def _log_marginal(c: np.ndarray, b: np.ndarray, shape: float, rate: np.ndarray | float) -> np.ndarray:
    lg = np.vectorize(math.lgamma)
    return shape * np.log(rate) - math.lgamma(shape) + lg(shape + c) - (shape + c) * np.log(rate + b)


def bayesian_scan(windows: DataFrame, prior: float = 0.01, shape: float = 1.0, multipliers: tuple[float, ...] = (1.5, 2.0, 3.0)) -> DataFrame:
    """windows (observed, expected) with their posterior; the prior is spread over all windows, and the null has the rest."""

    @F.pandas_udf("double")
    def factor(observed: pd.Series, expected: pd.Series) -> pd.Series:
        c, b = observed.to_numpy(dtype=float), expected.to_numpy(dtype=float)
        null = _log_marginal(c, b, shape, shape)
        other = np.stack([_log_marginal(c, b, shape, shape / m) for m in multipliers])
        top = other.max(axis=0)
        return pd.Series(top + np.log(np.exp(other - top).mean(axis=0)) - null)

    scored = windows.withColumn("log_factor", factor("observed", "expected"))
    whole = scored.agg(F.count("*").alias("_n"), F.max("log_factor").alias("_top"), F.sum(F.exp("log_factor")).alias("_sum"))
    joined = scored.join(F.broadcast(whole))
    weight = F.lit(prior) * F.exp("log_factor") / F.col("_n")
    return joined.withColumn("posterior", weight / (F.lit(1 - prior) + F.lit(prior) * F.col("_sum") / F.col("_n"))).withColumn("conditional", F.exp("log_factor") / F.col("_sum")).drop("_n", "_top", "_sum")
