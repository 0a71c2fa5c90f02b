"""Signals against truth, against another detector's, and several models' signals on one scale of evidence.

Intervals meet by weeks: both sides are copied to each week they touch, so that joins have a key whatever the length of
time, and an interval of a year has 53 rows, not one a day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resistrum.sources.shared import written

EVERYWHERE = "All locations"


def _name(c: str) -> Column:
    return F.upper(F.trim(c))


def _weeks(rows: DataFrame, begin: str, end: str) -> DataFrame:
    at = lambda c: F.expr(f"unix_date({c}) div 7")
    return rows.where(F.col(begin) <= F.col(end)).withColumn("_week", F.explode(F.sequence(at(begin), at(end))))


def matched(signals: DataFrame, outbreaks: DataFrame, *keys: str) -> DataFrame:
    """(keys, signal_id, outbreak_id, localised, overlap_days, jaccard) of signals (signal_id, organism, location, begin, end) and seeded outbreaks that share keys, organism, place and days.

    An outbreak (outbreak_id, organism, organism_code, ward, begin, end) is known by name or code, whatever the case. A signal of
    all locations matches everywhere, an outbreak of all wards is matched by any signal. Rows without name or day match nothing.
    """
    s = signals.select(*keys, "signal_id", _name("organism").alias("_organism"), _name("location").alias("_at"), F.col("begin").alias("_b"), F.col("end").alias("_e")).where("_organism <> ''")
    names = F.array_distinct(F.filter(F.array(_name("organism"), _name("organism_code")), lambda x: x.isNotNull()))
    o = outbreaks.select(*keys, "outbreak_id", F.explode(names).alias("_organism"), _name("ward").alias("_ward"), "begin", "end")
    met = _weeks(s, "_b", "_e").join(_weeks(o, "begin", "end"), [*keys, "_organism", "_week"]).where("_b <= end AND begin <= _e")
    pooled, anywhere, here = F.coalesce(F.col("_at") == EVERYWHERE.upper(), F.lit(False)), F.coalesce(F.col("_ward") == "ALL WARDS", F.lit(False)), F.coalesce(F.col("_at") == F.col("_ward"), F.lit(False))
    overlap = F.datediff(F.least("_e", "end"), F.greatest("_b", "begin")) + 1
    union = F.datediff(F.greatest("_e", "end"), F.least("_b", "begin")) + 1
    good = met.where(pooled | anywhere | here)
    return good.select(*keys, "signal_id", "outbreak_id", (here | (anywhere & pooled)).alias("localised"), overlap.cast("long").alias("overlap_days"), (overlap / union).alias("jaccard")).distinct()


def unmatched(signals: DataFrame, outbreaks: DataFrame) -> DataFrame:
    """The false alerts: signals that match no outbreak."""
    return signals.join(matched(signals, outbreaks).select("signal_id").distinct(), "signal_id", "left_anti")


def one_to_one(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """(their_id, our_id, delta) of clusters matched one to one: theirs, by falling llr, each take the nearest of ours that is left.

    Both are (id, location, begin, end), theirs with llr; a pair shares its location and a day, and is near by the days between begins
    plus those between ends; ties go to the smaller id. In rounds: a pair is final if ours is the nearest left to theirs, and theirs is the
    strongest left of all that could take ours. The strongest of all always has such a pair, so every round ends some.
    """
    t = theirs.select(F.col("id").alias("their_id"), F.trim("location").alias("_at"), F.col("begin").alias("_b"), F.col("end").alias("_e"), "llr")
    o = ours.select(F.col("id").alias("our_id"), F.trim("location").alias("_at"), "begin", "end")
    met = _weeks(t, "_b", "_e").join(_weeks(o, "begin", "end"), ["_at", "_week"]).where("_b <= end AND begin <= _e")
    delta = F.abs(F.datediff("_b", "begin")) + F.abs(F.datediff("_e", "end"))
    left = written(met.select("their_id", "our_id", "llr", delta.alias("delta")).distinct(), "pairs")
    done: list[DataFrame] = []
    while not left.isEmpty():
        nearest = left.groupBy("their_id").agg(F.min(F.struct("delta", "our_id"))["our_id"].alias("our_id"))
        strongest = left.groupBy("our_id").agg(F.min(F.struct((-F.col("llr")).alias("k"), "their_id"))["their_id"].alias("their_id"))
        final = written(left.join(nearest, ["their_id", "our_id"]).join(strongest, ["their_id", "our_id"]), "final")
        done.append(final)
        left = written(left.join(final.select("their_id"), "their_id", "left_anti").join(final.select("our_id"), "our_id", "left_anti"), "pairs")
    return reduce(DataFrame.unionByName, done, left.limit(0)).select("their_id", "our_id", F.col("delta").cast("long").alias("delta"))


def pooled(results: DataFrame, mechanisms: DataFrame) -> DataFrame:
    """results (isolate_id, agent, result, and others) with one row per isolate and mechanism: R before I before S.

    mechanisms is (agent, mechanism); an agent without one stands for itself. Rows with other results are left out.
    """
    others = [c for c in results.columns if c not in ("agent", "result")]
    rank = F.when(F.col("result") == "R", 3).when(F.col("result") == "I", 2).when(F.col("result") == "S", 1)
    named = results.join(mechanisms.select("agent", "mechanism"), "agent", "left").withColumns({"agent": F.coalesce("mechanism", "agent"), "_rank": rank}).where("_rank IS NOT NULL")
    best = named.groupBy(*others, "agent").agg(F.max("_rank").alias("_rank"))
    return best.withColumn("result", F.element_at(F.array(*map(F.lit, "SIR")), F.col("_rank"))).drop("_rank")


def merged_models(signals: DataFrame, n_models: int) -> DataFrame:
    """One row per cluster of signals (signal_id, model, organism, agent, location, begin, end, llr, p_value, mean, sd) that two models found.

    evidence is llr in deviations of its model's null maxima from their mean. A signal of model 'proportion' joins the strongest of
    model 'case-only' with the same organism, agent and location that shares a day with it. The row is that of the smallest p_value, then
    most evidence; p_value becomes 1 - (1 - p) ** n_models. Signals of one model never share stream, place and day.
    """
    evidence = F.when(F.col("sd") > 1e-9, F.round((F.col("llr") - F.col("mean")) / F.col("sd"), 3)).otherwise(F.round("llr", 3))
    keyed = signals.withColumns({"_organism": F.coalesce(_name("organism"), F.lit("")), "_agent": F.coalesce(_name("agent"), F.lit("")), "evidence": evidence})
    first = _weeks(keyed.where("model = 'case-only'"), "begin", "end").select("_organism", "_agent", "location", "_week", F.col("begin").alias("_b"), F.col("end").alias("_e"), F.col("llr").alias("_llr"), F.col("signal_id").alias("_group"))
    met = _weeks(keyed.where("model = 'proportion'"), "begin", "end").join(first, ["_organism", "_agent", "location", "_week"]).where("_b <= end AND begin <= _e")
    joined = met.groupBy("signal_id").agg(F.min(F.struct((-F.col("_llr")).alias("k"), "_group"))["_group"].alias("_group"))
    every = keyed.join(joined, "signal_id", "left").withColumn("_group", F.coalesce("_group", "signal_id"))
    best = F.min_by(F.struct(*[c for c in signals.columns if c not in ("llr", "mean", "sd")]), F.struct("p_value", (-F.col("evidence")).alias("k"), "signal_id"))
    p_of = lambda m: F.min(F.when(F.col("model") == m, F.col("p_value")))
    groups = every.groupBy("_group").agg(best.alias("b"), F.max("evidence").alias("evidence"), F.count("*").alias("n_models"), p_of("case-only").alias("p_case_only"), p_of("proportion").alias("p_proportion"))
    rows = groups.select("b.*", "evidence", "n_models", "p_case_only", "p_proportion")
    combined = F.round(1 - F.pow(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p_value"))), F.lit(n_models)), 4) if n_models > 1 else F.round("p_value", 4)
    return rows.withColumn("p_value", combined).withColumn("recurrence_days", F.when(F.col("p_value") > 0, F.round(1 / F.col("p_value"), 1)).otherwise(0.0))


def plausibility(signals: DataFrame, cases: DataFrame, window_days: int = 14) -> DataFrame:
    """signal_id, n_cases and plausibility: the share of a signal's cases whose stay meets that of another at the same location.

    cases: organism, agent (resistant to; null for an organism's isolates whatever they resist), location, specimen_date, admission_date. A stay
    lasts from admission to specimen, or window_days around the specimen if no admission before it is known. Equal stays are counted
    before they are put in order, so that an order is as long as a signal's days at most.
    """
    s = signals.select("signal_id", _name("organism").alias("_organism"), F.coalesce(_name("agent"), F.lit("")).alias("_agent"), F.col("location").alias("_at"), "begin", "end")
    c = cases.select(_name("organism").alias("_organism"), F.coalesce(_name("agent"), F.lit("")).alias("_agent"), "location", "specimen_date", "admission_date").withColumn("_week", F.expr("unix_date(specimen_date) div 7"))
    met = _weeks(s, "begin", "end").join(c, ["_organism", "_agent", "_week"]).where((F.col("specimen_date").between(F.col("begin"), F.col("end"))) & ((F.col("_at") == EVERYWHERE) | (F.col("_at") == F.col("location"))))
    known = F.coalesce(F.col("admission_date") <= F.col("specimen_date"), F.lit(False))
    stays = met.select("signal_id", "location", F.when(known, F.col("admission_date")).otherwise(F.date_sub("specimen_date", window_days)).alias("_from"), F.when(known, F.col("specimen_date")).otherwise(F.date_add("specimen_date", window_days)).alias("_to"))
    counts = stays.groupBy("signal_id", "location", "_from", "_to").agg(F.count("*").alias("n"))
    order = Window.partitionBy("signal_id", "location").orderBy("_from", "_to")
    before, after = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lead("_from").over(order)
    meets = F.coalesce(before >= F.col("_from"), F.lit(False)) | F.coalesce(after <= F.col("_to"), F.lit(False)) | (F.col("n") > 1)
    sums = counts.withColumn("_meets", meets).groupBy("signal_id").agg(F.sum("n").alias("n_cases"), F.sum(F.when(F.col("_meets"), F.col("n")).otherwise(0)).alias("_good"))
    out = signals.select("signal_id").join(sums, "signal_id", "left").fillna(0, ["n_cases"])
    return out.select("signal_id", "n_cases", F.when(F.col("n_cases") >= 2, F.round(F.col("_good") / F.col("n_cases"), 4)).otherwise(0.0).alias("plausibility"))


def alert_threshold(per_site_year: float, site_years: Column, replicates: int) -> Column:
    """The p-value up to which signals alert, for a budget of alerts: between what the replicates resolve and 0.05."""
    return F.greatest(F.lit(1.0 / (replicates + 1)), F.least(F.lit(0.05), F.lit(per_site_year) * F.greatest(site_years, F.lit(1e-9))))


def banded_order() -> list[Column]:
    """Alerts first; then by evidence in whole deviations, plausibility, evidence, p_value. Plausibility orders within a band only."""
    band = F.floor(F.col("evidence") + 0.5)
    return [F.when(F.col("status") == "alert", 0).otherwise(1), band.desc(), F.desc("plausibility"), F.desc("evidence"), F.col("p_value").asc(), F.col("signal_id").asc()]


def evaluated(signals: DataFrame, cases: DataFrame, n_models: int, per_site_year: float, site_years: float, replicates: int, window_days: int = 14) -> DataFrame:
    """The clusters of several models' signals with status, evidence and plausibility."""
    clusters = merged_models(signals, n_models)
    scored = clusters.join(plausibility(clusters, cases, window_days), "signal_id")
    return scored.withColumn("status", F.when(F.col("p_value") <= alert_threshold(per_site_year, F.lit(site_years), replicates), "alert").otherwise("monitor"))
