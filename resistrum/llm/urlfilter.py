"""URL filters by a Bloom filter cascade.

Level 1 holds the listed keys; level 2 holds those other keys of the corpus that level 1 lets through by mistake;
level 3 holds the listed keys that level 2 lets through, and so on until a level lets nothing wrong through. For
every key of the universe the cascade was built over, the first level that lacks it tells exactly whether it is
listed. Judging a url then takes no join: the cascade is a few bytes per listed key and goes to every task.

Cases: a null url, or one without "://", has an empty host and an empty path and fits no rule; an empty table or
an empty list gives no matches; repeated rules count once (a rule that is both allowed and blocked is allowed);
repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resistrum.llm.common import lookup_join, written

#: Above this many listed keys, rules are joined instead of sent to every task. 4 million keys are 16 MB or so.
MOST_LISTED = 4_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def candidates(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All keys (host or a parent domain, then a path prefix of one of the lengths) of a url, longest first."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(parents, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return F.transform(F.reverse(F.array_sort(F.transform(F.array_distinct(keys), lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))), lambda x: x["k"])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Level:
    """A Bloom filter over pairs of 64-bit hashes. `number` makes the bits of each level independent."""

    def __init__(self, number: int, n: int, rate: float):
        self.number = number
        self.bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64) * 64)
        self.hashes = max(1, round(self.bits / n * math.log(2)))
        self.words = np.zeros(self.bits // 64, dtype=np.uint64)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        turn = np.uint64(0x9E3779B97F4A7C15 * (self.number + 1) % 2**64)
        first, step = _mix(h1.astype(np.int64).view(np.uint64) ^ turn), _mix(h2.astype(np.int64).view(np.uint64) + turn)
        return (first[:, None] + np.arange(self.hashes, dtype=np.uint64) * (step[:, None] | np.uint64(1))) % np.uint64(self.bits)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.places(h1, h2)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)

    def fill(self, keys: DataFrame) -> Level:
        """Sets the bits of keys (h1, h2). Tasks send the words they set; the driver gets bits / 64 words at most."""

        def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                at = self.places(b["h1"].to_numpy(), b["h2"].to_numpy()).ravel()
                word, place = np.unique(at >> np.uint64(6), return_inverse=True)
                bits = np.zeros(len(word), dtype=np.uint64)
                np.bitwise_or.at(bits, place, np.uint64(1) << (at & np.uint64(63)))
                yield pd.DataFrame({"word": word.astype(np.int64), "bits": bits.view(np.int64)})

        for word, bits in keys.select("h1", "h2").mapInPandas(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits")).toLocalIterator():
            self.words[word] = np.int64(bits).view(np.uint64)
        return self


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key is listed; exact for the keys of the universe."""
        listed, open_ = np.zeros(len(h1), dtype=bool), np.arange(len(h1))
        for level in self.levels:
            passed = level.has(h1[open_], h2[open_])
            listed[open_] = level.number % 2 == 1
            if level.number % 2 == 0:
                listed[open_[passed]] = True
            else:
                listed[open_[passed]] = False
            open_ = open_[passed]
        return listed


def hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64(F.lit("a"), "key").alias("h1"), F.xxhash64(F.lit("b"), "key").alias("h2"))


def _passing(level: Level, keys: DataFrame) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(h1.to_numpy(), h2.to_numpy()))

    return keys.where(passes("h1", "h2"))


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade that tells listed (key) from all other keys of universe (key; repeats are fine)."""
    right, levels = written(hashed(listed.distinct()), "listed"), []
    n_right, wrong, n_wrong = right.count(), None, universe.count()
    original = right
    while n_right if not levels else (n_wrong if len(levels) % 2 else n_right):
        number = len(levels)
        if number > 200:
            raise ValueError("two keys have equal hashes")
        if number % 2 == 0:
            rate = min(0.5, n_right * math.sqrt(0.5) / max(n_wrong, 1)) if not number else 0.5
            level = Level(number, n_right, rate).fill(right)
            before = hashed(universe) if wrong is None else wrong
            after = _passing(level, before)
            if wrong is None:
                after = after.join(original.select("key"), "key", "left_anti").distinct()
            wrong = written(after, "wrong")
            n_wrong = wrong.count()
        else:
            level = Level(number, n_wrong, 0.5).fill(wrong)
            right = written(_passing(level, right), "listed")
            n_right = right.count()
        levels.append(level)
    return Cascade(levels)


def judged(pages: DataFrame, rules: DataFrame, most_listed: int = MOST_LISTED) -> DataFrame:
    """pages (page_id, url) with host, path, rule and verdict; rules has host, path, verdict (allow or block).

    The longest rule that fits wins. A url that fits none is not listed, and so allowed.
    """
    spark = pages.sparkSession
    rules = written(rules.select(F.concat("host", "path").alias("key"), F.length("path").alias("n"), (F.col("verdict") == "block").alias("block")).groupBy("key", "n").agg(F.bool_and("block").alias("block")), "rules")
    lengths = sorted(r[0] for r in rules.select("n").distinct().collect())
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("keys", candidates(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>"))
    if rules.limit(most_listed + 1).count() > most_listed:
        return _joined(urls, rules)
    universe = urls.select(F.explode("keys").alias("key"))
    listed = rules.select("key")
    member = spark.sparkContext.broadcast(build_cascade(listed, universe))
    blocks = spark.sparkContext.broadcast(build_cascade(rules.where("block").select("key"), listed))

    @F.pandas_udf("struct<place: int, block: boolean>")
    def found(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        sizes = np.array([len(x) for x in a], dtype=np.int64)
        place, block = np.zeros(len(a), dtype=np.int32), np.zeros(len(a), dtype=bool)
        if sizes.sum():
            h1, h2 = (np.concatenate([np.asarray(x, dtype=np.int64) for x in s]) for s in (a, b))
            hits = np.flatnonzero(member.value.has(h1, h2))
            row = np.repeat(np.arange(len(a)), sizes)[hits]
            rows, first = np.unique(row, return_index=True)
            at = hits[first]
            place[rows] = at - (np.cumsum(sizes) - sizes)[rows] + 1
            block[rows] = blocks.value.has(h1[at], h2[at])
        return pd.DataFrame({"place": place, "block": block})

    hashes = [F.transform("keys", lambda k: F.xxhash64(F.lit("a"), k)), F.transform("keys", lambda k: F.xxhash64(F.lit("b"), k))]
    said = urls.withColumn("said", found(*hashes))
    rule = F.when(F.col("said.place") > 0, F.get("keys", F.col("said.place") - 1))
    return said.select("page_id", "host", "path", rule.alias("rule"), F.when(F.col("said.block"), "block").otherwise("allow").alias("verdict"))


def _joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The way beyond MOST_LISTED: keys meet the rules in a join, whatever the list's length."""
    keys = urls.select("url", F.explode("keys").alias("_key"), F.monotonically_increasing_id().alias("_salt"))
    best = lookup_join(keys, rules.select(F.col("key").alias("_key"), "block"), "_key", F.col("_salt"))
    best = best.groupBy(F.col("url").alias("_url")).agg(F.max(F.struct(F.length("_key").alias("n"), F.col("_key").alias("rule"), "block")).alias("best"))
    out = urls.join(best, urls["url"] == best["_url"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best.block"), "block").otherwise("allow").alias("verdict"))
