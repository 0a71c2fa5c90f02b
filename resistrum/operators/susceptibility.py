"""Tables of susceptibility: rates by agent, ward and month, grids, indicators, cubes. I is tested, not resistant."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resistrum.functions.stats import percent

RELIABLE = 30


def _counts() -> list[Column]:
    return [F.count("result").alias("tested"), *(F.count_if(F.col("result") == x).alias(x.lower()) for x in "RIS")]


def rates(ast: DataFrame, *keys: str) -> DataFrame:
    """tested, r, i, s and their percentages by keys."""
    found = ast.groupBy(*keys).agg(*_counts())
    return found.select(*keys, "tested", "r", "i", "s", *[percent(F.col(x), F.col("tested")).alias(f"pct_{x}") for x in "ris"])


def measured_rates(ast: DataFrame) -> DataFrame:
    """Rates by agent with the mean, least, median and greatest measurement."""
    found = ast.groupBy("agent").agg(*_counts(), F.avg("measurement").alias("mean"), F.min("measurement").alias("least"), F.percentile("measurement", 0.5).alias("median"), F.max("measurement").alias("most"))
    return found.withColumn("pct_r", percent(F.col("r"), F.col("tested")))


def grid(ast: DataFrame, agents: list[str]) -> DataFrame:
    """A row per organism and for each agent the share that is not resistant (null if fewer than RELIABLE were tested)."""
    one = ast.groupBy("organism").pivot("agent", agents).agg(F.count("result").alias("n"), F.count_if(F.col("result") == "R").alias("r"))
    cells = [F.when(F.col(f"`{a}_n`") >= RELIABLE, 100.0 - F.lit(100.0) * F.col(f"`{a}_r`") / F.col(f"`{a}_n`")).alias(f"s_{k}") for k, a in enumerate(agents)]
    return one.select("organism", *cells)


def totals(isolates: DataFrame) -> DataFrame:
    """Isolates by organism, by specimen, by month and in all, in one pass."""
    month = isolates.withColumn("month", F.date_format("specimen_date", "yyyy-MM"))
    found = month.groupingSets([["organism"], ["specimen"], ["month"], []], "organism", "specimen", "month").agg(F.count("*").alias("n"), F.grouping_id().alias("_id"))
    kind = F.when(F.col("_id") == 3, "organism").when(F.col("_id") == 5, "specimen").when(F.col("_id") == 6, "month").otherwise("all")
    return found.select(kind.alias("kind"), F.coalesce("organism", "specimen", "month").alias("label"), "n")


def summary(isolates: DataFrame) -> DataFrame:
    distinct = [F.countDistinct(c).alias(f"n_{c}") for c in ("patient", "organism", "specimen", "site", "location")]
    return isolates.agg(F.count("*").alias("n"), *distinct, F.min("specimen_date").alias("first_date"), F.max("specimen_date").alias("last_date"))


def quality(isolates: DataFrame) -> DataFrame:
    """Lags and gaps of the record."""
    lag = F.datediff("specimen_date", "admission_date")
    return isolates.agg(
        F.count("*").alias("n"), F.count_if(F.col("patient").isNull()).alias("no_patient"), F.count_if(F.col("organism").isNull()).alias("no_organism"), F.count_if(lag < 0).alias("before_admission"),
        F.median(F.when(lag >= 0, lag)).alias("median_lag"),
    )


@dataclass(frozen=True)
class Indicator:
    """Isolates of an organism that contains one of the tokens: tested with one of the agents, positive to one."""

    label: str
    organisms: tuple[str, ...]
    agents: tuple[str, ...]
    positive: tuple[str, ...] = ("R", "I")


#: The priority indicators.
_ECO, _ENTERO = ("escherichia coli", "e. coli"), ("escherichia coli", "e. coli", "klebsiella", "enterobacter", "serratia", "citrobacter", "proteus", "morganella")
INDICATORS = (
    Indicator("MRSA among Staphylococcus aureus", ("staphylococcus aureus", "s. aureus"), ("FOX", "OXA")),
    Indicator("Vancomycin-nonsusceptible Enterococcus", ("enterococcus",), ("VAN",)),
    Indicator("3GC-nonsusceptible Escherichia coli", _ECO, ("CTX", "CRO", "CAZ")),
    Indicator("3GC-nonsusceptible Klebsiella pneumoniae", ("klebsiella pneumoniae",), ("CTX", "CRO", "CAZ")),
    Indicator("Carbapenem-nonsusceptible Enterobacterales", _ENTERO, ("MEM", "IPM", "ETP")),
    Indicator("Carbapenem-nonsusceptible Pseudomonas aeruginosa", ("pseudomonas aeruginosa",), ("MEM", "IPM")),
    Indicator("Carbapenem-nonsusceptible Acinetobacter spp.", ("acinetobacter",), ("MEM", "IPM")),
    Indicator("Fluoroquinolone-resistant Escherichia coli", _ECO, ("CIP", "LVX"), ("R",)),
    Indicator("Penicillin-nonsusceptible Streptococcus pneumoniae", ("streptococcus pneumoniae",), ("PEN",)),
)


def indicators(ast: DataFrame, wanted: tuple[Indicator, ...] = INDICATORS) -> DataFrame:
    """label, denominator, numerator and pct, over isolates (isolate_id); one pass, as each row meets each indicator as a column."""
    organism = F.lower("organism")
    fits = [F.exists(F.array(*map(F.lit, x.organisms)), lambda t: F.contains(organism, t)) & F.col("agent").isin(*x.agents) & F.col("result").isNotNull() for x in wanted]
    marks = F.array(*[F.when(fit, F.struct(F.lit(x.label).alias("label"), F.col("result").isin(*x.positive).alias("hit"))) for fit, x in zip(fits, wanted, strict=True)])
    rows = ast.select("isolate_id", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m"))
    by_isolate = rows.groupBy("m.label", "isolate_id").agg(F.bool_or("m.hit").alias("hit"))
    found = by_isolate.groupBy("label").agg(F.count("*").alias("denominator"), F.count_if("hit").alias("numerator"))
    return found.withColumn("pct", percent(F.col("numerator"), F.col("denominator")))


def denominators(ast: DataFrame) -> DataFrame:
    """Tested and resistant by day, location, organism and agent; agent '' counts isolates, which is not the agents' sum."""
    day = ast.where("result IS NOT NULL").withColumnRenamed("specimen_date", "day")
    by_agent = day.groupBy("day", "location", "organism", "agent").agg(F.count("*").alias("tested"), F.count_if(F.col("result") == "R").alias("resistant"))
    isolate = day.groupBy("day", "location", "organism", "isolate_id").agg(F.bool_or(F.col("result") == "R").alias("_r"))
    whole = isolate.groupBy("day", "location", "organism").agg(F.count("*").alias("tested"), F.count_if("_r").alias("resistant"))
    return by_agent.union(whole.select("day", "location", "organism", F.lit("").alias("agent"), "tested", "resistant"))
