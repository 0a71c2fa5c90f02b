"""Evaluation of detectors and audit: calibration, concordance, moments, coverage, Bernoulli CUSUM, hash chains."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(nulls: DataFrame, *keys: str) -> DataFrame:
    """Mean and population deviation of simulated maxima (llr)."""
    return nulls.groupBy(*keys).agg(F.avg("llr").alias("mean"), F.stddev_pop("llr").alias("sd"), F.count("llr").alias("n"))


def standardised(llr: Column, mean: Column, sd: Column) -> Column:
    """In deviations from the mean; as it is where there is no deviation."""
    return F.when(sd > 0, (llr - mean) / sd).otherwise(llr)


def alert_budget(target: float, site_years: Column, permutations: int) -> Column:
    """The p-value that spends `target` alerts a site-year, between what permutations resolve and 0.05."""
    return F.least(F.greatest(F.lit(target) * site_years, F.lit(1.0 / (permutations + 1))), F.lit(0.05))


def calibrated(nulls: DataFrame, budget: int, *keys: str) -> DataFrame:
    """The value after the budget-th largest of each group: alerts are strictly above it, so that at most `budget` nulls would alert.

    A group of no more than `budget` values has minus infinity. Values that aren't finite don't count.
    """
    finite = F.col("llr").isNotNull() & ~F.isnan("llr") & (F.abs("llr") < float("inf"))
    groups = nulls.groupBy(*keys).agg(F.count_if(finite).alias("nulls"))
    order = Window.partitionBy(*keys).orderBy(F.desc("llr"))
    after = nulls.where(finite).withColumn("_n", F.row_number().over(order)).where(F.col("_n") == budget + 1).select(*keys, F.col("llr").alias("threshold"))
    return groups.join(after, list(keys), "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("-inf"))))


def spearman(pairs: DataFrame, *keys: str) -> DataFrame:
    """Rank correlation of x and y with average ranks for ties; pairs with a null do not count.

    Ranks come from counts by value, so that a value's repeats never sort as rows of their own.
    """
    known = pairs.where("x IS NOT NULL AND y IS NOT NULL")
    for c in ("x", "y"):
        counts = known.groupBy(*keys, c).agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1))
        ranks = counts.select(*keys, c, (F.coalesce(before, F.lit(0)) + (F.col("_n") + 1) / 2).alias(f"_r{c}"))
        known = known.join(ranks, [*keys, c])
    return known.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def bland_altman(pairs: DataFrame, *keys: str) -> DataFrame:
    """Bias of x - y, its sample deviation and the limits of agreement."""
    d = pairs.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*keys).agg(F.avg(F.col("x") - F.col("y")).alias("bias"), F.stddev_samp(F.col("x") - F.col("y")).alias("sd"), F.count("*").alias("n"))
    return d.withColumns({"low": F.col("bias") - 1.96 * F.col("sd"), "high": F.col("bias") + 1.96 * F.col("sd")})


def site_years(cells: DataFrame) -> DataFrame:
    return cells.agg((F.sum(F.col("sites") * F.col("days")) / 365.25).alias("site_years"))


def denominator_coverage(rows: DataFrame) -> DataFrame:
    """What the denominators (day, location, organism, agent, tested, resistant) span."""
    counts = [F.countDistinct(c).cast("long").alias(f"n_{c}s") for c in ("day", "location", "organism", "agent")]
    return rows.agg(*counts, F.sum("tested").alias("tested"), F.sum("resistant").alias("resistant"))


def bernoulli_cusum(series: DataFrame, p0: float, p1: float) -> DataFrame:
    """series (location, signal, day, cases, tested) with the CUSUM of the log likelihood ratio of p1 against p0.

    max(0, s + w) step by step is the running sum less its least value so far (at most 0).
    """
    w = F.col("cases") * math.log(p1 / p0) + (F.col("tested") - F.col("cases")) * math.log((1 - p1) / (1 - p0))
    order = Window.partitionBy("location", "signal").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    total = series.withColumn("_total", F.sum(w).over(order))
    return total.withColumn("cusum", F.col("_total") - F.least(F.lit(0.0), F.min("_total").over(order))).drop("_total")


def combined_llr(streams: DataFrame, *keys: str) -> DataFrame:
    """The sum of the positive ratios of a window's streams, and how many they are."""
    return streams.groupBy(*keys).agg(F.sum(F.greatest(F.col("llr"), F.lit(0.0))).alias("llr"), F.count_if(F.col("llr") > 0).alias("streams"))


def _ascii(json: Column) -> Column:
    """json with every character beyond ASCII written as \\u and four digits, those beyond the first plane as two surrogates."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(c: Column) -> Column:
        n = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
        high, low = F.lit(0xD800) + F.shiftright(n - 0x10000, 10), F.lit(0xDC00) + F.pmod(n - 0x10000, F.lit(1024))
        return F.when(n < 128, c).when(n < 0x10000, unit(n)).otherwise(F.concat(unit(high), unit(low)))

    return F.when(json.rlike(r"^[\x00-\x7F]*$"), json).otherwise(F.array_join(F.transform(F.split(json, ""), escaped), ""))


def canonical(columns: list[str]) -> Column:
    """A row as ASCII JSON with its keys in order; nulls are written. Columns may be structs whose fields are in order."""
    return _ascii(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}))


def details_digest(details: Column) -> Column:
    """What an entry's hash holds of its details (canonical JSON), so that details can be erased and the chain still verifies."""
    return F.sha2(details, 256)


def entry_hash(previous: Column, entry: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), entry), 256)


def broken_links(chain: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Rows (keys, seq) of an audit chain that don't hold, and why: reason is 'link', 'entry' or 'details'.

    A link is broken if previous_hash isn't the hash of the row before (empty for the first), an entry if hash isn't that of
    previous_hash and the columns, details if their digest isn't details_digest. Rows with a digest hash that instead of their
    details; erased ones have none to hold against it. Every row is judged, not only the first that fails.
    """
    known = chain.withColumns({c: F.col(c) if c in chain.columns else F.lit(None).cast("string") for c in ("details", "details_digest", "erased_at")})
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(*keys).orderBy("seq")), F.lit(""))
    previous = F.coalesce("previous_hash", F.lit(""))
    own = F.when(F.coalesce("details_digest", F.lit("")) == "", entry_hash(previous, canonical([*columns, "details"]) if "details" in chain.columns else canonical(columns))).otherwise(entry_hash(previous, canonical([*columns, "details_digest"])))
    altered = (F.coalesce("details_digest", F.lit("")) != "") & (F.coalesce("erased_at", F.lit("")) == "") & ~details_digest(F.col("details")).eqNullSafe(F.col("details_digest"))
    reason = F.when(previous != F.col("_before"), "link").when(~F.col("hash").eqNullSafe(own), "entry").when(altered, "details")
    return known.withColumn("_before", before).withColumn("reason", reason).where("reason IS NOT NULL").select(*keys, "seq", "reason")
