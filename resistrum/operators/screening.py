"""Filters, look-ups and orders of records: cohort filters, buckets, histories, dispatches, retention, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Organisms that contaminate blood cultures.
CONTAMINANTS = (
    "coagulase-negative staphylococcus", "staphylococcus epidermidis", "staphylococcus hominis", "staphylococcus haemolyticus", "staphylococcus capitis",
    "staphylococcus warneri", "corynebacterium", "cutibacterium", "propionibacterium", "micrococcus", "bacillus",
)

#: Sites of a block, and pairs of a query and a site that a task makes.
BLOCK, PAIRS = 1000, 2_000_000


def named(column: str, values: list[str]) -> Column:
    """Any of values, without case and outer white space."""
    return F.lower(F.trim(column)).isin([v.strip().lower() for v in values])


def containing(column: str, values: list[str]) -> Column:
    """Any of values as a part of the text, without case."""
    found = F.lit(False)
    for v in values:
        found = found | F.lower(column).contains(v.strip().lower())
    return found


def within(column: str, begin: str | None, end: str | None) -> Column:
    """In the period, ends included; rows without a date stay only if neither end is set."""
    if begin is None and end is None:
        return F.lit(True)
    day = F.col(column)
    inside = day.isNotNull()
    inside = inside if begin is None else inside & (day >= F.lit(begin).cast("date"))
    return inside if end is None else inside & (day <= F.lit(end).cast("date"))


def record_filter(records: DataFrame, equal: dict[str, list[str]] | None = None, like: dict[str, list[str]] | None = None, period: tuple[str, str | None, str | None] | None = None) -> DataFrame:
    """Records that meet all filters; an empty list of values filters nothing."""
    for column, values in (equal or {}).items():
        records = records.where(named(column, values)) if values else records
    for column, values in (like or {}).items():
        records = records.where(containing(column, values)) if values else records
    return records if period is None else records.where(within(*period))


def bucket_filter(buckets: DataFrame, labels: list[str], least: int) -> DataFrame:
    """Buckets (label, value) whose label holds any of labels and whose value is at least `least`."""
    kept = buckets.where(F.col("value") >= least)
    return kept.where(containing("label", labels)) if labels else kept


def blood_contaminant(specimen: str, organism: str, tokens: tuple[str, ...] = CONTAMINANTS) -> Column:
    return F.lower(specimen).contains("blood") & containing(organism, list(tokens)) & ~F.lower(organism).contains("bacillus anthracis")


def expired(columns: list[str], cutoff: str) -> Column:
    """The latest of the dates is known and before the cutoff."""
    latest = F.greatest(*[F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, 10) for c in columns])
    return (latest != "") & (latest < F.lit(cutoff))


def breached(value: Column, comparison: Column, threshold: Column) -> Column:
    tests = {"gt": value > threshold, "gte": value >= threshold, "lt": value < threshold, "lte": value <= threshold}
    found = F.lit(False)
    for name, test in tests.items():
        found = F.when(comparison == name, test).otherwise(found)
    return F.coalesce(value.isNotNull() & found, F.lit(False))


def rare_results(results: DataFrame, keys: list[str], isolate: str, least: int = 20, share: float = 5.0) -> DataFrame:
    """Alerts (isolate, keys, agent, result, alert) on results (isolate, keys, agent, result R, I or S) that the history of their keys makes unusual.

    The history is that of the other isolates of the same keys, at least `least`. 'result': R or S, of an agent tested in at least `least` of
    them, that less than `share` per cent of those have. 'test': an agent tested in some, but in less than `share` per cent. Counts are
    made once, by keys and by keys and agent; a row takes its own isolate out of them.
    """
    known = results.where(F.col("result").isin("R", "I", "S")).groupBy(isolate, *keys, "agent").agg(F.max("result").alias("result"))
    isolates = results.select(isolate, *keys).distinct().groupBy(*keys).agg((F.count("*") - 1).alias("history"))
    counts = known.groupBy(*keys, "agent").agg((F.count("*") - 1).alias("tested"), F.count_if(F.col("result") == "R").alias("_r"), F.count_if(F.col("result") == "S").alias("_s"))
    row = known.join(counts, [*keys, "agent"]).join(isolates, keys).where(F.col("history") >= least)
    same = F.when(F.col("result") == "R", F.col("_r")).when(F.col("result") == "S", F.col("_s")) - 1
    rare = F.when((F.col("tested") >= least) & (100.0 * same < share * F.col("tested")), "result")
    seldom = F.when((F.col("tested") > 0) & (100.0 * F.col("tested") < share * F.col("history")), "test")
    return row.withColumn("alert", F.explode(F.filter(F.array(rare, seldom), lambda x: x.isNotNull()))).select(isolate, *keys, "agent", "result", "history", "tested", "alert")


def identified(records: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """wanted with the oldest record (smallest isolate_id) of the same identity, or null. Case and white space around a key don't count; an identity that lacks a key is none."""
    plain = lambda c: F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))
    oldest = records.groupBy(*[plain(k).alias(f"_{k}") for k in keys]).agg(F.min("isolate_id").alias("isolate_id"))
    return wanted.withColumns({f"_{k}": plain(k) for k in keys}).join(oldest, [f"_{k}" for k in keys], "left").select(*wanted.columns, "isolate_id")


def pending(queries: DataFrame, dispatches: DataFrame, sites: DataFrame, now: str | None = None) -> DataFrame:
    """(query_id, site) still to be sent: of active queries that have not expired, to the sites that targets name, or to all if it is null; an empty list is nobody.

    A dispatch made before counts unless it is pending. queries: query_id, targets, and, if it has them, status and expires_at.
    Sites are gathered in blocks of about BLOCK, and a query meets a block in a row of its own: what a row holds is bounded, what is made
    are the pairs to be sent, and tasks grow with these.
    """
    active = queries
    if "status" in queries.columns:
        active = active.where("status = 'active'")
    if "expires_at" in queries.columns and now is not None:
        active = active.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))
    sent = dispatches.where("status <> 'pending'") if "status" in dispatches.columns else dispatches
    n_sites = sites.count()
    blocks = max(1, -(-n_sites // BLOCK))
    parts = max(1, -(-active.where("targets IS NULL").count() * n_sites // PAIRS))
    block = F.pmod(F.xxhash64("site"), F.lit(blocks)).alias("_block")
    every = sites.groupBy(block).agg(F.collect_set("site").alias("_every"))
    done = sent.select("query_id", "site", block).repartition(parts, "query_id", "_block").groupBy("query_id", "_block").agg(F.collect_set("site").alias("_done"))
    wanted = active.select("query_id", "targets").join(F.broadcast(every.select("_block"))).repartition(parts, "query_id", "_block")
    wanted = wanted.join(F.broadcast(every), "_block").join(done, ["query_id", "_block"], "left")
    left = F.array_except(F.when(F.col("targets").isNull(), F.col("_every")).otherwise(F.array_intersect("targets", "_every")), F.coalesce("_done", F.array().cast(done.schema["_done"].dataType)))
    return wanted.select("query_id", F.explode(left).alias("site"))


def cases_in_clusters(cases: DataFrame, clusters: DataFrame) -> DataFrame:
    """cases (day, location, signal) within a cluster's days at its location; a cluster without location is of all.

    Each cluster is a row for each of its days, so that the interval is an equi-join.
    """
    days = clusters.select("cluster_id", F.col("location").alias("_at"), "signal", F.explode(F.sequence("begin", "end")).alias("day"))
    return cases.join(days, ["signal", "day"]).where("_at IS NULL OR _at = location").drop("_at")


def ranked_children(latest: DataFrame, n: int = 20) -> DataFrame:
    """The n children of highest rate, those without a rate last, then by name. A top-k report."""
    return latest.orderBy(F.desc_nulls_last("rate"), "child").limit(n)


def online_first(sites: DataFrame) -> list[Column]:
    """The order of sites: those online, then by name and code without case."""
    return [F.when(sites["online"], 0).otherwise(1), F.lower("name"), F.lower("code")]


def place_rank(name: Column, asked: str) -> Column:
    """0 for the name itself, 1 for its begin, 2 for a part of it; null for other places."""
    n, q = F.lower(F.trim(name)), asked.strip().lower()
    return F.when(n == q, 0).when(n.startswith(q), 1).when(n.contains(q), 2)


def path_prefixes(paths: DataFrame) -> DataFrame:
    """The distinct begins (prefix, level) of admin_path."""
    parts = F.split("admin_path", "/")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("prefix"), (k - 1).alias("level")))
    return paths.where("admin_path IS NOT NULL").select("admin_path").distinct().select(F.explode(begins).alias("p")).select("p.prefix", F.col("p.level").cast("long").alias("level")).distinct()


def newest_alerts(alerts: DataFrame) -> DataFrame:
    """Of alerts with the same rule and message, the last by alert_id."""
    last = Window.partitionBy("rule", "message").orderBy(F.desc("alert_id"))
    return alerts.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
