"""A catalogue of measures as rows, and all of them at all scopes in one aggregation.

Answers of sites are matched with the catalogue, the newest of each site and measure kept, and each copied to the scopes that its
site lies in: the world, each admin unit above it, the site itself. Then one grouping by measure, scope and label sums all of
them, so that cost grows with answers and depth, not with the number of measures or scopes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resistrum.functions.stats import wilson

#: The measures of resistance (key, organism, agent's code, specimen), each a rate of answers about that organism and agent.
RESISTANCE = (
    ("res_eco_carbapenem", "Escherichia coli", "MEM", ""), ("res_eco_3gc", "Escherichia coli", "CRO", ""), ("res_eco_fq", "Escherichia coli", "CIP", ""), ("res_kpn_carbapenem", "Klebsiella pneumoniae", "MEM", ""),
    ("res_kpn_3gc", "Klebsiella pneumoniae", "CRO", ""), ("res_kpn_colistin", "Klebsiella pneumoniae", "COL", ""), ("res_sau_mrsa", "Staphylococcus aureus", "OXA", ""), ("res_efm_vre", "Enterococcus faecium", "VAN", ""),
    ("res_pae_carbapenem", "Pseudomonas aeruginosa", "MEM", ""), ("res_aba_carbapenem", "Acinetobacter baumannii", "MEM", ""), ("res_sat_fq", "Salmonella Typhi", "CIP", ""), ("res_bsi_eco_carbapenem", "Escherichia coli", "MEM", "blood"),
    ("res_bsi_kpn_carbapenem", "Klebsiella pneumoniae", "MEM", "blood"),
)
#: Measures of phenotypes, of volume (with the type of answer they sum), of coverage, and the grid.
PHENOTYPES = ("phen_esbl", "phen_cre", "phen_crab", "phen_crpa", "phen_mdr")
BURDENS = (("burden_isolates", "isolate_count"), ("burden_organism_mix", "organism_distribution"), ("burden_specimen_mix", "specimen_distribution"))
COVERAGE = ("cov_sites_reporting", "cov_sites_online", "cov_geo", "cov_ast_completeness")
GRID = "antibiogram"
_CATALOGUE = "metric string, family string, query_type string, organism string, agent string, specimen string"


def catalogue(spark: SparkSession, more: list[tuple[str, str, str, str, str, str]] | None = None) -> DataFrame:
    """The 26 measures and `more`; a key that is there twice is refused. Of no organism or specimen are answers that name none."""
    rows = [(k, "resistance", "resistance_rate", o, a, s) for k, o, a, s in RESISTANCE] + [(k, "phenotype", "resistance_rate", "", "", "") for k in PHENOTYPES]
    rows += [(k, "burden", q, "", "", "") for k, q in BURDENS] + [(k, "coverage", "", "", "", "") for k in COVERAGE] + [(GRID, "antibiogram", "", "", "", "")] + list(more or [])
    keys = [r[0] for r in rows]
    if len(set(keys)) < len(keys):
        raise ValueError(f"keys twice: {sorted({k for k in keys if keys.count(k) > 1})}")
    return spark.createDataFrame(rows, _CATALOGUE)


def _scoped(rows: DataFrame) -> DataFrame:
    """rows (site, admin_path, ...) once for each scope that the site lies in."""
    parts = F.split("admin_path", "/")
    units = F.when(F.coalesce(F.col("admin_path"), F.lit("")) != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.concat(F.lit("admin"), (k - 1).cast("string")).alias("type"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("value"))))
    none = F.array().cast("array<struct<type: string, value: string>>")
    every = F.concat(F.array(F.struct(F.lit("global").alias("type"), F.lit("").alias("value"))), F.coalesce(units, none), F.array(F.struct(F.lit("site").alias("type"), F.col("site").cast("string").alias("value"))))
    return rows.withColumn("_scope", F.explode(every)).withColumns({"scope_type": F.col("_scope.type"), "scope_value": F.col("_scope.value")}).drop("_scope")


def newest_answers(answers: DataFrame, metrics: DataFrame) -> DataFrame:
    """For each measure and site the newest answer that fits: of its type and agent, about its organism and specimen or, if it names none, about none.

    answers: site, query_type, agent, organism, specimen, ok, received_at, numerator, denominator, total, buckets (a map of counts by label).
    An organism fits by its first word. Of answers of one time, that with the larger denominator or total counts.
    """
    m = F.broadcast(metrics.where("query_type <> ''").select("metric", "family", "query_type", F.lower(F.split("organism", " ")[0]).alias("_organism"), F.col("agent").alias("_agent"), F.lower("specimen").alias("_specimen")))
    text = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    fits = (F.col("_agent") == "") | (F.col("_agent") == F.col("agent"))
    about = lambda want, c: F.when(F.col(want) != "", F.contains(text(c), F.col(want))).otherwise(text(c) == "")
    rate = (F.col("query_type") != "resistance_rate") | (fits & about("_organism", "organism") & about("_specimen", "specimen"))
    kept = answers.where("ok").join(m, "query_type").where(rate)
    entries = F.array_sort(F.map_entries("buckets"), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    best = F.max(F.struct("received_at", "denominator", "total", "numerator", entries.alias("buckets")))
    return kept.groupBy("metric", "family", "query_type", "site").agg(best.alias("a")).select("metric", "family", "query_type", "site", "a.numerator", "a.denominator", "a.total", "a.buckets")


def measured(answers: DataFrame, sites: DataFrame, metrics: DataFrame, now: str, floor: int = 5, online_minutes: int = 5) -> DataFrame:
    """(metric, scope_type, scope_value, label, numerator, denominator, n_sites, rate_percent, ci_low_percent, ci_high_percent) of all measures at all scopes.

    Rates have numerator and denominator and, of resistance, a 95 % Wilson interval; numbers have the numerator only. Distributions have a
    row per label of at least `floor`; coverage of units has one per level. sites: site, admin_path, status, last_seen_at; answers of sites
    that aren't there are left out. The share of isolates with results has no answer to be taken from: it is null.
    """
    at = sites.select("site", "admin_path")
    zero = F.lit(None).cast("string")
    newest = newest_answers(answers, metrics)
    labels = F.when(F.col("query_type").endswith("_distribution"), F.transform(F.coalesce("buckets", F.array().cast("array<struct<key: string, value: bigint>>")), lambda e: F.struct(e["key"].alias("label"), e["value"].cast("long").alias("n"))))
    one = F.array(F.struct(zero.alias("label"), F.when(F.col("query_type") == "resistance_rate", F.col("numerator")).otherwise(F.col("total")).cast("long").alias("n")))
    taken = newest.withColumn("_e", F.explode(F.coalesce(labels, one))).join(at, "site")
    rows = taken.select("metric", "site", "admin_path", F.col("_e.label").alias("label"), F.coalesce("_e.n", F.lit(0)).cast("long").alias("numerator"), F.when(F.col("query_type") == "resistance_rate", F.coalesce("denominator", F.lit(0))).cast("long").alias("denominator"), F.lit(None).cast("string").alias("unit"))
    active = sites.where("status = 'active'")
    known = active.join(answers.where("ok").select("site").distinct().withColumn("_answered", F.lit(True)), "site", "left")
    online = F.coalesce(F.col("last_seen_at") >= F.lit(now).cast("timestamp") - F.make_interval(mins=F.lit(online_minutes)), F.lit(False))
    each = F.array(F.struct(F.lit("cov_sites_reporting").alias("metric"), F.coalesce("_answered", F.lit(False)).alias("yes")), F.struct(F.lit("cov_sites_online").alias("metric"), online.alias("yes")), F.struct(F.lit("cov_ast_completeness").alias("metric"), F.lit(None).cast("boolean").alias("yes")))
    coverage = known.withColumn("_c", F.explode(each)).select("_c.metric", "site", "admin_path", zero.alias("label"), F.col("_c.yes").cast("long").alias("numerator"), F.lit(1).cast("long").alias("denominator"), zero.alias("unit"))
    parts = F.split("admin_path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.struct(F.concat(F.lit("admin"), (k - 1).cast("string")).alias("label"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("unit")))
    units = active.where("admin_path LIKE '%/%'").withColumn("_u", F.explode(above)).select(F.lit("cov_geo").alias("metric"), "site", "admin_path", F.col("_u.label").alias("label"), F.lit(1).cast("long").alias("numerator"), F.lit(None).cast("long").alias("denominator"), F.col("_u.unit").alias("unit"))
    wanted = metrics.select("metric", "family")
    every = _scoped(rows.unionByName(coverage).unionByName(units)).join(F.broadcast(wanted), "metric")
    sums = every.groupBy("metric", "family", "scope_type", "scope_value", "label").agg(
        F.sum("numerator").alias("_sum"), F.count_distinct("unit").alias("_units"), F.sum("denominator").alias("denominator"), F.count_distinct(F.when((F.col("family") == "burden") | (F.col("denominator") > 0), F.col("site"))).alias("n_sites"),
    )
    out = sums.withColumn("numerator", F.when(F.col("metric") == "cov_geo", F.col("_units")).otherwise(F.col("_sum"))).where(~F.col("label").isNotNull() | (F.col("metric") == "cov_geo") | (F.col("numerator") >= floor))
    low, high = wilson(F.col("numerator"), F.col("denominator"))
    rate = F.when(F.col("denominator") > 0, 100.0 * F.col("numerator") / F.col("denominator"))
    rate = F.when(F.col("family") == "coverage", F.round(rate, 1)).otherwise(F.round(rate, 2))
    bounded = F.col("family").isin("resistance", "phenotype")
    return out.select("metric", "scope_type", "scope_value", "label", "numerator", "denominator", "n_sites", rate.alias("rate_percent"), F.when(bounded, F.round(100 * low, 2)).alias("ci_low_percent"), F.when(bounded, F.round(100 * high, 2)).alias("ci_high_percent"))
