"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Each rule compares a rate of a document with a cutoff that is chosen per stratum (language). Labelled documents
say how many good ones a cutoff would reject. A cutoff counts as safe if the exact binomial probability of seeing
that few false rejections, were the true rate above its limit, is at most delta / (strata x rules). Within a
stratum and rule, cutoffs are tested from the loosest on and testing stops at the first that is not safe, so that
all safe cutoffs hold together with probability 1 - delta. Of the safe ones, the cutoff with the largest margin
of rejected bad over rejected good documents is used, the loosest of equals. A stratum with too few labels gets
none, and keeps what the base rules keep. The limits of the rules of a stratum add up to alpha.

Cases: a null text has no words and fails the base rules; a null language is a stratum of its own; labels that
contradict each other or are null are left out; labels for unknown documents and null ids are ignored; repeated
rows get equal verdicts; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resistrum.llm.common import WORD, lookup_join, words, written

LEAST_WORDS = 10
WINDOW = 5
#: Repeated words in percent of all words, above which the base rules reject.
MOST_REPEATED = 20
#: Over all rules of a stratum together, the share of good documents that may be rejected, and the risk of more.
ALPHA, DELTA = 0.05, 0.05
#: Rules as (name, numerator, denominator).
RULES = (("symbols", "n_symbols", "word_chars"), ("lines", "n_dup_lines", "n_lines"), ("repeats", "n_repeat_words", "n_words"), ("capitals", "n_capitals", "word_chars"))
#: Cutoffs are i / STEPS for i from 0 to STEPS - 1; a document is rejected if its rate is above.
STEPS = 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_capitals.

    Windows of words are compared by 64-bit hashes; only texts in which two are equal are looked at again, by a
    sort of (hash, place) within the row.
    """
    own = [c for c in docs.columns if c.lower() not in {*BASE, "n_lines", "n_capitals"}]
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    d = docs.select(*own, words(F.col("text")).alias("_words"), lines.alias("_lines"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"))
    d = d.select(*own, "n_symbols", "n_capitals", F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"))
    windows = F.when(F.size("_h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("_w", windows).drop("_h")
    repeated = F.size(F.array_distinct("_w")) < F.size("_w")
    d = d.withColumn("_s", F.when(repeated, F.array_sort(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))).drop("_w")
    again = F.filter("_s", lambda x, i: (x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"]))
    d = d.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["p"]))).drop("_s")
    gaps = F.aggregate(F.sequence(F.lit(1), F.size("_p") - 1), F.lit(WINDOW), lambda n, i: n + F.least(F.lit(WINDOW), F.get("_p", i) - F.get("_p", i - 1)))
    return d.withColumn("n_repeat_words", F.when(F.col("_p").isNull(), 0).otherwise(gaps).cast("long")).drop("_p")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _step(top: str, under: str) -> Column:
    """How many cutoffs i / STEPS lie below the rate."""
    return F.when(F.col(under) > 0, F.least(F.ceil(F.col(top) * STEPS / F.col(under)), F.lit(STEPS))).otherwise(0).cast("int")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial with n trials of probability p; 1 if k is not below n * p, where no test could pass."""
    start = F.struct((n * F.lit(math.log1p(-p))).alias("term"), (n * F.lit(math.log1p(-p))).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(math.log(p) - math.log1p(-p))
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, add, lambda acc: F.exp(acc["total"]))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(tail)


def thresholds(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row per stratum: lang and a map from rule to step (of cutoff step / STEPS); rules without a safe cutoff are missing."""
    quality = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    marked = features.where(~base_failed()).join(quality.select("doc_id", (F.col("low") > 0).alias("good")), "doc_id")
    steps = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), _step(a, b).alias("step")) for name, a, b in RULES]))
    counted = marked.select("lang", "good", steps.alias("x")).groupBy("lang", "x.rule", "x.step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    sums = counted.groupBy("lang", "rule").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), F.map_from_entries(F.collect_list(F.struct("step", F.struct("good", "bad").alias("n")))).alias("at"))
    above = lambda i, side: F.aggregate(F.map_entries(F.col("at")), F.lit(0).cast("long"), lambda n, e: n + F.when(e["key"] > i, e["value"][side]).otherwise(0))
    tested = sums.select("lang", "rule", "n_good", "n_bad", "at", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step")).select("lang", "rule", "n_good", "n_bad", "step", above(F.col("step"), "good").alias("k_good"), above(F.col("step"), "bad").alias("k_bad"))
    strata = F.lit(1) if (n := counted.select("lang").distinct().count()) <= 1 else F.lit(n)
    safe = binomial_tail(F.col("k_good"), F.col("n_good"), alpha / len(RULES)) <= F.lit(delta) / (strata * len(RULES))
    from_loosest = Window.partitionBy("lang", "rule").orderBy(F.desc("step"))
    margin = F.when(F.col("n_bad") > 0, F.col("k_bad") / F.col("n_bad")).otherwise(0.0) - F.when(F.col("n_good") > 0, F.col("k_good") / F.col("n_good")).otherwise(0.0)
    held = tested.withColumn("held", F.min(safe).over(from_loosest)).where("held")
    best = held.groupBy("lang", "rule").agg(F.max(F.struct(margin.alias("margin"), "step")).alias("best")).where("best.margin > 0")
    return best.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("rule", "best.step"))).alias("cutoffs"))


def verdict() -> Column:
    """kept, by the base rules and the column _cutoffs."""
    over = F.lit(False)
    for name, a, b in RULES:
        over = over | F.coalesce(_step(a, b) > F.col("_cutoffs")[name], F.lit(False))
    return ~base_failed() & ~over


def _with_cutoffs(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    strata = features.select(F.col("lang").alias("_stratum")).distinct()
    every = written(strata.join(cutoffs, strata["_stratum"].eqNullSafe(cutoffs["lang"]), "left").select("_stratum", F.col("cutoffs").alias("_cutoffs")), "cutoffs")
    return lookup_join(features.withColumn("_stratum", F.col("lang")), every, "_stratum", F.xxhash64("doc_id"))


def scored(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row per document: doc_id, lang, the measures, base_failed and kept. Texts are read once."""
    features = written(measured(docs.select("doc_id", "lang", "text")), "features")
    judged = _with_cutoffs(features, thresholds(features, labels, alpha, delta))
    return judged.select("doc_id", "lang", *BASE, "n_lines", "n_capitals", base_failed().alias("base_failed"), verdict().alias("kept"))


def kept(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that the rules keep, with docs' columns. Texts are measured once and written with their measures."""
    named = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "lang", "text")
    features = written(measured(named).drop("text"), "features")
    return _with_cutoffs(features, thresholds(features, labels, alpha, delta)).where(verdict()).select("_row.*")
