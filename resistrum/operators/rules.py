"""Joins of results with rule tables: breakpoints, alerts, expected resistance, criteria."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resistrum.functions.clinical import interpreted


def with_breakpoints(ast: DataFrame, breakpoints: DataFrame, key: list[str]) -> DataFrame:
    """ast with s and r of its most specific breakpoint, and the reading of its measurement.

    breakpoints (organism, agent, specimen, location_type, s, r): a null specimen or location_type fits all, and each
    one that is not null counts for specificity. Equally specific rows that differ leave the reading empty. The
    breakpoints of an organism and agent meet a row as one array, so that rows are neither copied nor grouped.
    """
    fits = F.collect_list(F.struct("specimen", "location_type", "s", "r")).alias("_fits")
    b = breakpoints.groupBy(F.col("organism").alias("_o"), F.col("agent").alias("_a")).agg(fits)
    joined = ast.join(b, (F.col("organism") == F.col("_o")) & (F.col("agent") == F.col("_a")), "left")
    fitting = lambda x: (x["specimen"].isNull() | (x["specimen"] == F.col("specimen"))) & (x["location_type"].isNull() | (x["location_type"] == F.col("location_type")))
    rank = lambda x: x["specimen"].isNotNull().cast("int") * 2 + x["location_type"].isNotNull().cast("int")
    ranked = F.transform(F.filter("_fits", fitting), lambda x: F.struct(rank(x).alias("rank"), x["s"].alias("s"), x["r"].alias("r")))
    kept = [c for c in ast.columns if c not in key]
    d = joined.select(*key, *kept, ranked.alias("_ranked"))
    top = F.array_distinct(F.filter("_ranked", lambda x: x["rank"] == F.array_max(F.transform("_ranked", lambda y: y["rank"]))))
    d = d.select(*key, *kept, F.when(F.size(top) == 1, F.get(top, F.lit(0))).alias("_top"))
    out = d.select(*key, *kept, F.col("_top.s").alias("s"), F.col("_top.r").alias("r"))
    return out.withColumn("reading", interpreted(F.col("measurement"), F.lit("MIC"), F.col("s"), F.col("r")))


def alerts(ast: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ast that a rule (organism, agent, results array, label) names, with its label."""
    r = rules.withColumnsRenamed({"organism": "_o", "agent": "_a"})
    return ast.join(r, (F.col("organism") == F.col("_o")) & (F.col("agent") == F.col("_a")) & F.array_contains("results", F.col("result"))).drop("_o", "_a", "results")


def unexpected(ast: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that are susceptible where resistance is expected (organism, agent, except_specimens)."""
    e = expected.withColumnsRenamed({"organism": "_o", "agent": "_a"})
    named = (F.col("organism") == F.col("_o")) & (F.col("agent") == F.col("_a")) & ~F.array_contains("except_specimens", F.col("specimen"))
    return ast.where("result = 'S'").join(e, named, "left_semi")


#: What a criterion's letters stand for.
_CLASSES = {"R": ("R",), "I": ("I",), "S": ("S",), "NS": ("R", "I"), "+": ("+",), "-": ("-",)}


def criteria(text: str, results: str = "results") -> Column:
    """`A=R AND B=NS OR C=S` over a map from agent to result: OR of ANDs. A missing agent fails its part."""
    whole = F.lit(False)
    for branch in re.split(r"\s+OR\s+", text.strip(), flags=re.I):
        part = F.lit(True)
        for term in re.split(r"\s+AND\s+", branch, flags=re.I):
            agent, _, wanted = (x.strip() for x in term.partition("="))
            if wanted.upper() not in _CLASSES:
                raise ValueError(f"not a criterion: {term}")
            part = part & F.coalesce(F.col(results)[agent].isin(*_CLASSES[wanted.upper()]), F.lit(False))
        whole = whole | part
    return whole


def longest_prefix(codes: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """codes (code) with the longest entry of known (prefix, place) that begins it: prefixes are exploded and joined on equality."""
    cut = F.transform(F.sequence(F.lit(least), F.length("code")), lambda n: F.substring("code", F.lit(1), n))
    tried = codes.where(F.length("code") >= least).select("code", F.explode(cut).alias("prefix"))
    best = tried.join(known, "prefix").groupBy("code").agg(F.max(F.struct(F.length("prefix").alias("n"), "prefix", "place")).alias("best"))
    return codes.join(best, "code", "left").select(*codes.columns, "best.prefix", "best.place")


def inverse_map(concepts: DataFrame) -> DataFrame:
    """concepts (source, target) by target; a target with more than one source is ambiguous and gets none."""
    found = concepts.groupBy("target").agg(F.countDistinct("source").alias("n"), F.min("source").alias("source"))
    return found.select("target", "n", F.when(F.col("n") == 1, F.col("source")).alias("source"))
