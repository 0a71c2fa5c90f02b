"""What detectors are worth on seeded data: evidence, outcomes by cell, endpoints, and days until an outbreak is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resistrum.functions.stats import llr_bernoulli, wilson
from resistrum.operators import scans, signals

#: The column by which each detector's signals are ranked.
RANKED_BY = {
    "llr": ("space-time-permutation", "bernoulli-space-time", "bernoulli-purely-temporal", "bernoulli-purely-spatial", "poisson-space-time", "poisson-purely-temporal", "multivariate"), "chart_exceedance": ("ewma", "cusum-poisson", "cusum-bernoulli"),
    "farrington_score": ("farrington",), "posterior": ("bayesian-scan",), "pace_evidence": ("pace",),
}


def evidence(found: DataFrame, detector: str = "detector") -> Column:
    """A signal's evidence on its detector's own scale; 0 if it isn't there, null of a detector that isn't known."""
    out = F.lit(None).cast("double")
    for column, detectors in RANKED_BY.items():
        value = F.coalesce(F.col(column).cast("double"), F.lit(0.0)) if column in found.columns else F.lit(0.0)
        out = F.when(F.col(detector).isin(*detectors), value).otherwise(out)
    return out


def admitted(found: DataFrame, thresholds: DataFrame, *keys: str) -> DataFrame:
    """The signals (keys, evidence) strictly above their threshold (see evaluation.calibrated)."""
    return found.join(thresholds.select(*keys, "threshold"), list(keys)).where("evidence > threshold").drop("threshold")


def outcomes(alerts: DataFrame, outbreaks: DataFrame, *keys: str) -> DataFrame:
    """A row for each cell (keys): outbreaks presented and detected, alerts, how many matched, false alerts, matches, localised ones, their jaccards.

    A cell without alerts or without outbreaks has zeros. A signal that matches two outbreaks counts once.
    """
    m = signals.matched(alerts, outbreaks, *keys)
    presented = outbreaks.groupBy(*keys).agg(F.count_distinct("outbreak_id").alias("presented"))
    alerted = alerts.groupBy(*keys).agg(F.count("*").alias("alerted"))
    found = m.groupBy(*keys).agg(
        F.count_distinct("outbreak_id").alias("detected"), F.count_distinct("signal_id").alias("matched"), F.count("*").alias("matches"), F.count_if("localised").alias("localised"), F.array_sort(F.collect_list("jaccard")).alias("jaccards")
    )
    both = presented.join(alerted, list(keys), "full").join(found, list(keys), "left").fillna(0)
    return both.withColumns({"jaccards": F.coalesce("jaccards", F.array().cast("array<double>")), "false_alerts": F.col("alerted") - F.col("matched")})


def endpoints(rows: DataFrame, *by: str) -> DataFrame:
    """Of rows of outcomes(): sensitivity with its interval, predictive_value, spatial_accuracy, and temporal_accuracy, the median jaccard; null where nothing was presented, alerted or matched."""
    sums = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("presented", "detected", "alerted", "matched", "false_alerts", "matches", "localised")])
    each = rows.select(*by, F.explode("jaccards").alias("_j"))
    middle = each.groupBy(*by).agg(F.median("_j").alias("temporal_accuracy"))
    joined = sums.join(middle, list(by), "left") if by else sums.join(F.broadcast(middle))
    low, high = wilson(F.col("detected"), F.col("presented"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return joined.withColumns({"sensitivity": share("detected", "presented"), "sensitivity_low": low, "sensitivity_high": high, "predictive_value": F.when(F.col("presented") > 0, share("matched", "alerted")), "spatial_accuracy": share("localised", "matches")})


def bernoulli_at_cuts(cells: DataFrame, key: str, max_days: int = 60, least: int = 3, least_tested: int = 10) -> DataFrame:
    """For each day on which the data may be cut: what the prospective scan of proportions finds in the data up to it (cut, key, location, begin, end, observed, tested, llr).

    Windows that end on the cut's last day have running sums for their counts and for their stream's totals, so that all cuts
    come from one pass; the result is that of a scan of each truncated table.
    """
    known = cells.where("tested > 0")
    _, first, last = scans.study(known, 36_500)
    if last is None:
        return known.select(F.col("day").alias("cut"), key, "location", F.col("day").alias("begin"), F.col("day").alias("end"), F.col("cases").alias("observed"), "tested", F.lit(0.0).alias("llr")).limit(0)
    found = scans.windows(known.select(key, "location", "day", F.col("cases").alias("observed"), "tested"), [key], first, last, ["observed", "tested"], max_days, prospective=False)
    longest = F.greatest(F.lit(1), F.floor((F.datediff("end", F.lit(first)) + 1) / 2))
    found = found.where((F.col("days") <= longest) & (F.col("observed") >= least) & (F.col("tested") >= least_tested))
    # a stream's totals at each day of the study
    days = known.select(key).distinct().withColumn("day", F.explode(F.sequence(F.lit(first), F.lit(last))))
    order = Window.partitionBy(key).orderBy("day")
    daily = known.groupBy(key, "day").agg(F.sum("cases").alias("cc"), F.sum("tested").alias("nn"))
    totals = days.join(daily, [key, "day"], "left").fillna(0, ["cc", "nn"]).select(key, F.col("day").alias("end"), F.sum("cc").over(order).alias("cc"), F.sum("nn").over(order).alias("nn"))
    scored = found.join(totals, [key, "end"]).withColumn("llr", llr_bernoulli(F.col("observed"), F.col("tested"), F.col("cc"), F.col("nn"))).where("llr > 1e-12")
    # the last day of the data up to a cut; the days of the study are one partition's work at most
    until = F.coalesce(F.date_sub(F.lead("day").over(Window.orderBy("day")), 1), F.col("day"))
    every = known.select("day").distinct().withColumn("_until", until).select(F.explode(F.sequence("day", "_until")).alias("cut"), F.col("day").alias("end"))
    return scored.join(F.broadcast(every), "end").select("cut", key, "location", "begin", "end", "observed", "tested", "llr")


def delays(found: DataFrame, outbreaks: DataFrame, threshold: float, stride: int = 1, most_cuts: int = 60) -> DataFrame:
    """outbreak_id and delay: the days from an outbreak's begin to the first cut at which an alert (llr above threshold) matches it; null if none does.

    found is that of a detector at every cut (cut, signal, location, begin, end, llr). An outbreak is looked for every `stride` days from its
    begin, most_cuts times at most, each time as far as it had come. Cuts are a key, so that all of them are matched at once and the first is a minimum.
    """
    cuts = outbreaks.withColumn("cut", F.explode(F.sequence("begin", F.date_add("begin", stride * (most_cuts - 1)), F.expr(f"INTERVAL {stride} DAY"))))
    visible = cuts.withColumn("end", F.least("end", "cut"))
    alerts = found.where(F.col("llr") > threshold).select("cut", F.col("signal").alias("organism"), "location", "begin", "end", F.concat_ws("/", "signal", "location", "begin", "end").alias("signal_id"))
    first = signals.matched(alerts, visible, "cut").groupBy("outbreak_id").agg(F.min("cut").alias("_cut"))
    return outbreaks.join(first, "outbreak_id", "left").select("outbreak_id", F.datediff("_cut", "begin").alias("delay"))
