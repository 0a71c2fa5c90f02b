"""Mixing sources to target weights.

Words are summed by source, a target for each source follows from the weights, and the rate target / size says
how often a document is taken: floor(rate) times, and once more for the documents whose seeded hash falls below
the fraction. Only one row per source is ever brought together.

Cases: a null text has no words; a null source is a source of its own, last in order; an empty table gives an
empty result; a source without words gets the target 0; rows with equal doc_id share one draw, and rows without
doc_id draw by their text; other columns are kept, but for those with a name of the result.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resistrum.llm.common import lookup_join, n_words, numbered, written

WEIGHTS = (1, 2, 3)
#: No source is repeated more often than this.
MOST = 3
SEED = "mix-1"


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1, below 1, that follows from the seed and the document alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (_source, _source_size; a row per source) with the column _target.

    The level is raised round by round: sources whose bound lies below their share get the bound, and the rest
    is shared anew. Each round is one sum over the table of sources and brings one row to the driver.
    """
    ranked = numbered(sizes, [F.col("_source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight.cast("long"))
    big = "decimal(38,0)"
    total, share_by, had = *ranked.agg(F.sum("_source_size"), F.sum("_weight")).first(), -1
    left = total = total or 0
    while share_by:
        full = F.col("_source_size").cast(big) * F.lit(Decimal(most * share_by)).cast("decimal(20,0)") < F.lit(Decimal(left)).cast("decimal(30,0)") * F.col("_weight").cast("decimal(7,0)")
        n, bound, rest = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("_source_size") * most)), F.sum(F.when(~full, F.col("_weight")))).first()
        if n == had:
            break
        had, left, share_by = n, total - (bound or 0), rest or 0
    if not share_by:
        return ranked.select("_source", "_source_size", (F.col("_source_size") * most).cast("double").alias("_target"))
    target = F.when(full, (F.col("_source_size") * most).cast("double")).otherwise(F.lit(float(left)) * F.col("_weight") / F.lit(float(share_by)))
    return ranked.select("_source", "_source_size", target.alias("_target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the document)."""
    kept = [c for c in docs.columns if c.lower() not in {"size", "source_size", "target", "copies"}]
    sized = docs.select(*kept, n_words(docs["text"]).alias("_size"), docs["source"].alias("_source_of"))
    sizes = docs.select(docs["source"].alias("_source"), n_words(docs["text"]).alias("_size")).groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    plan = written(source_targets(sizes, weights, most).withColumnRenamed("_source", "_source_of"), "mix-targets")
    rate = F.when(F.col("_source_size") > 0, F.least(F.col("_target") / F.col("_source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    copies = F.floor("_rate") + (draw(F.col("doc_id"), F.col("text"), seed) < F.col("_rate") - F.floor("_rate")).cast("long")
    joined = lookup_join(sized, plan, "_source_of", F.xxhash64("doc_id", "text")).withColumn("_rate", rate)
    return joined.select(*kept, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), copies.cast("long").alias("copies"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each document of docs as often as it is taken, with docs' columns."""
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_doc"))
    taken = mixed(packed, weights, most, seed).where("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return taken.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
