"""Roll-ups over the answers of sites: newest answer, sums with intervals, small cells, scopes, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resistrum.functions.stats import percent, wilson

#: No floor below this is accepted.
LEAST_FLOOR = 5


def floor_of(configured: int) -> int:
    return max(configured, LEAST_FLOOR)


def latest(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key. As one max per key it combines in the tasks and needs no sort."""
    rest = [c for c in results.columns if c not in {*keys, *order}]
    newest = F.max(F.struct(*order, *rest)).alias("_newest")
    return results.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in (*order, *rest)])


def rolled_up(results: DataFrame, *keys: str) -> DataFrame:
    """Sums of numerator and denominator over sites, rate and Wilson interval."""
    found = results.groupBy(*keys).agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.countDistinct("site").alias("n_sites"))
    low, high = wilson(F.col("numerator"), F.col("denominator"))
    return found.select(*keys, "numerator", "denominator", "n_sites", percent(F.col("numerator"), F.col("denominator")).alias("rate"), (low * 100).alias("low"), (high * 100).alias("high"))


def suppressed(counts: DataFrame, column: str, floor: int) -> DataFrame:
    """The cells that are large enough to publish."""
    return counts.where(F.col(column) >= floor_of(floor))


def scope(level: str, value: str | None) -> Column:
    """Sites of a scope: global, country, admin:N (by path) or site. A country without a value is all; what is not known matches nothing."""
    level = (level or "country").strip().lower()
    level = {"national": "country", "state": "admin:1", "district": "admin:2"}.get(level, level)
    if level == "global" or (level == "country" and not value):
        return F.lit(True)
    if not value:
        return F.lit(False)
    if level == "site":
        return F.col("site").cast("string") == value
    if level == "country" or level.startswith("admin:"):
        return (F.col("admin_path") == value) | F.col("admin_path").startswith(value + "/")
    return F.lit(False)


def by_prefix(results: DataFrame) -> DataFrame:
    """Each row once for each unit of its path (W, W/1, W/1/5), so that one grouping serves all levels."""
    parts = F.split("admin_path", "/")
    units = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return results.withColumn("unit", F.explode(units)).withColumn("level", F.size(F.split("unit", "/")) - 1)


def coverage(results: DataFrame, since: str) -> DataFrame:
    """Sites, those that answered since a day, and distinct units by level, as one row."""
    level = lambda k: F.countDistinct(F.when(F.size(F.split("admin_path", "/")) > k, F.array_join(F.slice(F.split("admin_path", "/"), 1, k + 1), "/")))
    return results.agg(F.countDistinct("site").alias("n_sites"), F.countDistinct(F.when(F.col("received_at") >= F.lit(since).cast("date"), F.col("site"))).alias("reporting"), level(1).alias("level_1"), level(2).alias("level_2"))


def last_points(snapshots: DataFrame, keys: list[str], order: str, n: int = 12) -> DataFrame:
    """The newest n rows of each series, numbered from the oldest."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    kept = snapshots.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).drop("_k")


def changed(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value differs between two snapshots, as added, removed or changed."""
    a, b = before.select(*keys, F.col(value).alias("before"), F.lit(1).alias("_a")), after.select(*keys, F.col(value).alias("after"), F.lit(1).alias("_b"))
    both = a.join(b, keys, "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("kind", kind).where("kind IS NOT NULL").drop("_a", "_b")


def benchmark(unit_rates: DataFrame, national: DataFrame) -> DataFrame:
    """Rates with their distance from the national one and a band."""
    joined = unit_rates.join(national.withColumnRenamed("rate", "national"), "agent")
    band = F.when(F.col("rate") >= 50, "critical").when(F.col("rate") >= 25, "high").when(F.col("rate") >= 10, "moderate").otherwise("low")
    return joined.withColumn("delta", F.col("rate") - F.col("national")).withColumn("band", band)
