"""Scan statistics over windows that may end on any day: counts against chance, proportions, rates, and several streams at once.

Cells are counts by stream, location and day. Sums over a window are differences of running sums, made by one window function per
(stream, location); a series is as long as the study, never as the data. Under chance, replicates are drawn in blocks of
locations: each task draws, from the same seed, how many cases each block of its stream gets, and then deals those of its
own block to cells. That is the same distribution as one draw over all cells, and no task holds more than a block.

Shapes: space-time; temporal (all locations as one); spatial (each location over the whole study).
"""

from __future__ import annotations

import datetime
import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resistrum.functions.stats import llr_bernoulli, llr_poisson, llr_space_time
from resistrum.sources.shared import written

#: Cells that a block of locations holds about; a stream of fewer has one block.
BLOCK_CELLS = 50_000
EVERYWHERE = "All locations"
SHAPES = ("space-time", "temporal", "spatial")


def with_categories(events: DataFrame, everything: str = "ALL") -> DataFrame:
    """events (signal, location, day) of signals at two places at least, and once more as one series that has the signals for places."""
    several = events.groupBy("signal").agg(F.count_distinct("location").alias("_n")).where("_n > 1").select("signal")
    pooled = events.withColumns({"location": F.col("signal"), "signal": F.lit(everything)})
    more = events.select("signal").distinct().agg(F.count("*").alias("_n")).where("_n > 1")
    return events.join(several, "signal", "left_semi").unionByName(pooled.join(F.broadcast(more.select(F.lit(everything).alias("signal"))), "signal", "left_semi"))


def study(cells: DataFrame, baseline_days: int = 365) -> tuple[DataFrame, datetime.date | None, datetime.date | None]:
    """The cells of the last baseline_days, with the study's first and last day."""
    first, last = cells.agg(F.min("day"), F.max("day")).first()
    if last is None:
        return cells, None, None
    first = max(first, last - datetime.timedelta(days=baseline_days - 1))
    return cells.where(F.col("day") >= F.lit(first)), first, last


def windows(cells: DataFrame, keys: list[str], first: datetime.date | None, last: datetime.date | None, sums: list[str], max_days: int = 60, prospective: bool = True, shape: str = "space-time") -> DataFrame:
    """All windows of cells (keys, location, day, and the columns of sums): keys, location, begin, end, days, and the sums within.

    Windows last at most max_days or half the study. prospective ones end on the study's last day.
    """
    if shape not in SHAPES:
        raise ValueError(shape)
    if last is None:
        first = last = datetime.date(1970, 1, 1)
    n_days = (last - first).days + 1
    if shape == "temporal":
        cells = cells.withColumn("location", F.lit(EVERYWHERE))
    if shape == "spatial":
        whole = cells.groupBy(*keys, "location").agg(*[F.sum(s).alias(s) for s in sums])
        return whole.select(*keys, "location", F.lit(first).alias("begin"), F.lit(last).alias("end"), F.lit(n_days).alias("days"), *sums)
    longest = max(1, min(max_days, n_days // 2))
    known = cells.groupBy(*keys, "location", "day").agg(*[F.sum(s).alias(s) for s in sums])
    if prospective:
        known = known.where(F.datediff(F.lit(last), "day") < longest)
    begin = F.lit(last - datetime.timedelta(days=longest - 1)) if prospective else F.lit(first)
    days = known.select(*keys, "location").distinct().withColumn("day", F.explode(F.sequence(begin, F.lit(last))))
    dense = days.join(known, [*keys, "location", "day"], "left").fillna(0, sums)
    order = Window.partitionBy(*keys, "location").orderBy("day")
    before = F.struct("day", *[(F.sum(s).over(order) - F.col(s)).alias(s) for s in sums])
    run = dense.select(*keys, "location", "day", *[F.sum(s).over(order).alias(s) for s in sums], before.alias("_before"))
    opened = run.withColumn("_opened", F.collect_list("_before").over(order.rowsBetween(1 - longest, 0)))
    if prospective:
        opened = opened.where(F.col("day") == F.lit(last))
    each = opened.withColumn("_from", F.explode("_opened"))
    return each.select(*keys, "location", F.col("_from.day").alias("begin"), F.col("day").alias("end"), (F.datediff("day", F.col("_from.day")) + 1).alias("days"), *[(F.col(s) - F.col(f"_from.{s}")).alias(s) for s in sums])


def space_time(events: DataFrame, baseline_days: int = 365, max_days: int = 60, least: int = 3, prospective: bool = True) -> DataFrame:
    """Windows of events (signal, location, day) with observed and expected cases and llr, where more are observed.

    Expected cases of a day are the location's cases of that day of the study modulo 7 times the day's share of all.
    """
    bounded, first, last = study(events, baseline_days)
    day = bounded.withColumn("_s", F.datediff("day", F.lit(first)) % 7)
    cells = day.groupBy("signal", "location", "day", "_s").agg(F.count("*").alias("observed"))
    by_day = cells.groupBy("signal", "_s", "day").agg(F.sum("observed").alias("_day"))
    by_stratum = by_day.groupBy("signal", "_s").agg(F.sum("_day").alias("_all"))
    at = cells.groupBy("signal", "location", "_s").agg(F.sum("observed").alias("_at"))
    share = at.join(by_stratum, ["signal", "_s"]).join(by_day, ["signal", "_s"])
    means = share.select("signal", "location", "day", (F.col("_at") * F.col("_day") / F.col("_all")).alias("expected"))
    both = means.join(cells.drop("_s"), ["signal", "location", "day"], "left").fillna(0, ["observed"])
    totals = by_stratum.groupBy("signal").agg(F.sum("_all").alias("total"))
    found = windows(both, ["signal"], first, last, ["observed", "expected"], max_days, prospective).where(F.col("observed") >= least).join(totals, "signal")
    # running sums may leave a rest of 1e-16 where observed and expected cases are equal
    exact = F.col("observed") > F.col("expected") + 1e-9
    return found.withColumn("llr", llr_space_time(F.col("observed"), F.col("expected"), F.col("total"))).where(exact & (F.col("llr") > 0))


def bernoulli(cells: DataFrame, keys: list[str], shape: str = "space-time", baseline_days: int = 365, max_days: int = 60, least: int = 3, least_tested: int = 10, prospective: bool = True) -> DataFrame:
    """Windows of cells (keys, location, day, tested, cases) whose proportion is higher than outside: observed, tested, the stream's totals, llr."""
    bounded, first, last = study(cells.where("tested > 0"), baseline_days)
    totals = bounded.groupBy(*keys).agg(F.sum("cases").alias("total_cases"), F.sum("tested").alias("total_tested"))
    known = bounded.select(*keys, "location", "day", F.col("cases").alias("observed"), "tested")
    found = windows(known, keys, first, last, ["observed", "tested"], max_days, prospective, shape).where((F.col("observed") >= least) & (F.col("tested") >= least_tested)).join(totals, keys)
    return found.withColumn("llr", llr_bernoulli(F.col("observed"), F.col("tested"), F.col("total_cases"), F.col("total_tested"))).where("llr > 1e-12")


def poisson(cells: DataFrame, population: DataFrame, keys: list[str], shape: str = "space-time", baseline_days: int = 365, max_days: int = 60, least: int = 3, least_expected: float = 0.5, prospective: bool = True) -> DataFrame:
    """Windows of cells (keys, location, day, cases) with more cases than their share of population (location, day, population): observed, population, expected, llr.

    Cases at a location without population have no expectation: they are left out, of totals too (see orphans).
    """
    cases, people, first, last = _at_risk(cells, population, baseline_days)
    totals = cases.groupBy(*keys).agg(F.sum("cases").alias("total_cases"))
    everyone = people.agg(F.sum("population").alias("total_population"))
    pairs = cases.select(*keys, "location").distinct() if shape != "temporal" else cases.select(*keys).distinct().join(F.broadcast(people.select("location").distinct()))
    dense = pairs.join(people, "location").join(cases, [*keys, "location", "day"], "outer").fillna(0, ["cases", "population"]).withColumnRenamed("cases", "observed")
    found = windows(dense, keys, first, last, ["observed", "population"], max_days, prospective, shape).where(F.col("observed") >= least).join(totals, keys).join(F.broadcast(everyone))
    found = found.withColumn("expected", F.col("total_cases") * F.col("population") / F.col("total_population")).where(F.col("expected") >= least_expected)
    return found.withColumn("llr", llr_poisson(F.col("observed"), F.col("population"), F.col("total_cases"), F.col("total_population"))).where("llr > 1e-12")


def _at_risk(cells: DataFrame, population: DataFrame, baseline_days: int) -> tuple[DataFrame, DataFrame, datetime.date | None, datetime.date | None]:
    people, some = population.where("population > 0"), cells.where("cases > 0")
    _, first, last = study(people.select("day").union(some.select("day")), baseline_days)
    if last is not None:
        people, some = (d.where(F.col("day") >= F.lit(first)) for d in (people, some))
    people = people.groupBy("location", "day").agg(F.sum("population").alias("population"))
    return some.join(people.select("location").distinct(), "location", "left_semi"), people, first, last


def orphans(cells: DataFrame, population: DataFrame) -> DataFrame:
    """The cells at locations that have no population."""
    return cells.join(population.where("population > 0").select("location").distinct(), "location", "left_anti")


def multivariate(results: DataFrame, baseline_days: int = 365, max_days: int = 60, least: int = 3, least_tested: int = 10, prospective: bool = True) -> DataFrame:
    """Windows over an organism's agents at once, of results (isolate_id, organism, agent, location, day, resistant): llr is the sum of the agents' positive ratios.

    observed and tested are sums over the agents that add to it, which agents names, the strongest first.
    """
    cells = results.groupBy("organism", "agent", "location", "day").agg(F.count("*").alias("tested"), F.sum(F.col("resistant").cast("long")).alias("cases"))
    single = bernoulli(cells, ["organism", "agent"], "space-time", baseline_days, max_days, 0, 0, prospective).where(F.col("total_tested") >= least_tested)
    # ratios that differ by less than 1e-9 are equal, and come by name
    strongest = F.transform(F.array_sort(F.collect_list(F.struct((-F.floor(F.col("llr") * 1e9)).alias("k"), "agent"))), lambda x: x["agent"])
    both = single.groupBy("organism", "location", "begin", "end", "days").agg(F.sum("observed").alias("observed"), F.sum("tested").alias("tested"), F.count("*").alias("streams"), strongest.alias("agents"), F.sum("llr").alias("llr"))
    return both.where(F.col("observed") >= least)


def _blocks(cells: DataFrame, keys: list[str], size: str, by: str | None = None) -> DataFrame:
    """cells with block (of locations) and blocks: the sums of size by block of the stream, in order of block; by value of `by` too, as parts."""
    counts = cells.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_CELLS)).cast("int").alias("_blocks"))
    placed = written(cells.join(counts, keys).withColumn("block", F.pmod(F.xxhash64("location"), F.col("_blocks")).cast("int")).drop("_blocks"), "cells")
    if by is None:
        sums = placed.groupBy(*keys, "block").agg(F.sum(size).alias("_n"))
    else:
        sums = placed.groupBy(*keys, "block", by).agg(F.sum(size).alias("_n")).groupBy(*keys, "block").agg(F.sum("_n").alias("_n"), F.collect_list(F.struct(by, "_n")).alias("parts"))
    each = F.struct("block", "_n", *(["parts"] if by else []))
    return placed.join(sums.groupBy(*keys).agg(F.array_sort(F.collect_list(each)).alias("blocks")), keys)


def _rng(seed: int, stream: object, *more: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr(stream).encode()), *more])


def _shares(blocks: list, own: int) -> tuple[np.ndarray, int]:
    names, sizes = [b["block"] for b in blocks], np.array([b["_n"] for b in blocks])
    return sizes, names.index(own)


def _grid(group: pd.DataFrame, day: pd.Series, n_days: int) -> tuple[np.ndarray, int]:
    """The flat place of each cell in a (locations, days) grid, and the number of locations."""
    at = pd.factorize(group["location"])[0]
    return at * n_days + day.to_numpy(), int(at.max()) + 1


def _running(x: np.ndarray) -> np.ndarray:
    """Of x (..., days): the sums before each day, and of all."""
    return np.concatenate([np.zeros((*x.shape[:-1], 1)), x.cumsum(axis=-1)], axis=-1)


def _window_sums(total: np.ndarray, length: int, prospective: bool) -> np.ndarray:
    """Of running sums: those of the windows of a length that end on the last day, or on any."""
    sums = total[..., length:] - total[..., :-length]
    return sums[..., -1:] if prospective else sums


def _counted(at: np.ndarray, weights: np.ndarray, n: int, n_days: int) -> np.ndarray:
    return np.bincount(at, weights=weights, minlength=n * n_days).reshape(n, n_days)


def _xlogx(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > 0, x * np.log(x / y), 0.0)


def _bernoulli_llr(c: np.ndarray, n: np.ndarray, cc: float, nn: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        high = (n > 0) & (n < nn) & (c / n > (cc - c) / (nn - n))
    llr = _xlogx(c, n) + _xlogx(n - c, n) + _xlogx(cc - c, nn - n) + _xlogx(nn - n - cc + c, nn - n) - _xlogx(np.float64(cc), np.float64(nn)) - _xlogx(np.float64(nn - cc), np.float64(nn))
    return np.where(high & (0 < cc < nn), llr, 0.0)


def _maxima(cells: DataFrame, keys: list[str], size: str, replicates: int, chunk: int, score: Callable[[pd.DataFrame, list, list[int]], np.ndarray], by: str | None = None) -> DataFrame:
    """replicate and top over all streams: score(cells of a block, its stream's blocks, replicates) in a task for each block and chunk of replicates."""
    begins = F.explode(F.sequence(F.lit(1), F.lit(replicates), F.lit(chunk))).alias("begin")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, begin = group.sort_values(["location", "day"]), int(group["begin"].iloc[0])
        several = list(range(begin, min(begin + chunk, replicates + 1)))
        return pd.DataFrame({"replicate": several, "top": score(group, list(group["blocks"].iloc[0]), several)})

    dealt = _blocks(cells, keys, size, by).select("*", begins)
    return dealt.groupBy(*keys, "block", "begin").applyInPandas(run, "replicate int, top double").groupBy("replicate").agg(F.max("top").alias("top"))


def _collapsed(cells: DataFrame, keys: list[str], sums: list[str], first: datetime.date, shape: str) -> DataFrame:
    """Cells with day as a number; of the temporal shape at one location."""
    at = F.lit(EVERYWHERE) if shape == "temporal" else F.col("location")
    return cells.select(*keys, at.alias("location"), F.datediff("day", F.lit(first)).alias("day"), *sums).groupBy(*keys, "location", "day").agg(*[F.sum(s).alias(s) for s in sums])


def bernoulli_maxima(cells: DataFrame, keys: list[str], replicates: int = 999, shape: str = "space-time", baseline_days: int = 365, max_days: int = 60, least: int = 3, least_tested: int = 10, prospective: bool = True, seed: int = 1, chunk: int = 50) -> DataFrame:
    """replicate and top: the highest ratio of all windows after cases are dealt anew to the tested, whose counts stay."""
    bounded, first, last = study(cells.where("tested > 0"), baseline_days)
    if last is None:
        return cells.sparkSession.createDataFrame([], "replicate int, top double")
    n_days, lengths = _lengths(first, last, max_days, shape)
    totals = bounded.groupBy(*keys).agg(F.sum("cases").alias("cc"), F.sum("tested").alias("nn")).where((F.col("cc") >= least) & (F.col("nn") >= least_tested))
    flat = _collapsed(bounded, keys, ["cases", "tested"], first, shape).join(totals, keys)

    def score(group: pd.DataFrame, blocks: list, several: list[int]) -> np.ndarray:
        stream, cc, nn = tuple(group[keys].iloc[0]), int(group["cc"].iloc[0]), int(group["nn"].iloc[0])
        sizes, own = _shares(blocks, int(group["block"].iloc[0]))
        tested, (at, n) = group["tested"].to_numpy(), _grid(group, group["day"], n_days)
        drawn = []
        for r in several:
            mine = _rng(seed, stream, r).multivariate_hypergeometric(sizes, cc)[own]
            drawn.append(_counted(at, _rng(seed, stream, r, own + 1).multivariate_hypergeometric(tested, mine), n, n_days))
        c, t, tops = _running(np.stack(drawn)), _running(_counted(at, tested, n, n_days)), np.zeros(len(several))
        for length in lengths:
            wc, wt = _window_sums(c, length, prospective), _window_sums(t, length, prospective)
            llr = np.where((wc >= least) & (wt >= least_tested), _bernoulli_llr(wc, wt, cc, nn), 0.0)
            tops = np.maximum(tops, llr.max(axis=(1, 2), initial=0.0))
        return tops

    return _maxima(flat, keys, "tested", replicates, chunk, score)


def _lengths(first: datetime.date, last: datetime.date, max_days: int, shape: str) -> tuple[int, list[int]]:
    n = (last - first).days + 1
    return n, [n] if shape == "spatial" else list(range(1, max(1, min(max_days, n // 2)) + 1))


def poisson_maxima(cells: DataFrame, population: DataFrame, keys: list[str], replicates: int = 999, shape: str = "space-time", baseline_days: int = 365, max_days: int = 60, least: int = 3, least_expected: float = 0.5, prospective: bool = True, seed: int = 1, chunk: int = 50) -> DataFrame:
    """replicate and top: the highest ratio of all windows after a stream's cases are dealt to its cells by their population.

    A cell without cases gets none, as it is no cell of the stream; its population counts in what a window expects.
    """
    cases, people, first, last = _at_risk(cells, population, baseline_days)
    if last is None:
        return cells.sparkSession.createDataFrame([], "replicate int, top double")
    n_days, lengths = _lengths(first, last, max_days, shape)
    everyone = people.agg(F.sum("population").alias("pp"))
    totals = cases.groupBy(*keys).agg(F.sum("cases").alias("cc")).where(F.col("cc") >= least)
    pairs = cases.select(*keys, "location").distinct() if shape != "temporal" else cases.select(*keys).distinct().join(F.broadcast(people.select("location").distinct()))
    dense = pairs.join(people, "location").join(cases, [*keys, "location", "day"], "outer").fillna(0, ["cases", "population"])
    weighed = dense.withColumn("weight", F.when(F.col("cases") > 0, F.col("population")).otherwise(0.0))
    flat = _collapsed(weighed, keys, ["cases", "population", "weight"], first, shape).join(totals, keys).join(F.broadcast(everyone))

    def score(group: pd.DataFrame, blocks: list, several: list[int]) -> np.ndarray:
        stream, cc, pp = tuple(group[keys].iloc[0]), int(group["cc"].iloc[0]), float(group["pp"].iloc[0])
        sizes, own = _shares(blocks, int(group["block"].iloc[0]))
        tops, weight, (at, n) = np.zeros(len(several)), group["weight"].to_numpy(), _grid(group, group["day"], n_days)
        if sizes.sum() <= 0 or weight.sum() <= 0:
            return tops
        drawn = []
        for r in several:
            mine = _rng(seed, stream, r).multinomial(cc, sizes / sizes.sum())[own]
            drawn.append(_counted(at, _rng(seed, stream, r, own + 1).multinomial(mine, weight / weight.sum()), n, n_days))
        c, p = _running(np.stack(drawn)), _running(_counted(at, group["population"].to_numpy(), n, n_days))
        for length in lengths:
            wc, e = _window_sums(c, length, prospective), cc * _window_sums(p, length, prospective) / pp
            good = (wc >= least) & (e >= least_expected) & (wc > e) & (e < cc)
            llr = np.where(good, _xlogx(wc, e) + _xlogx(cc - wc, cc - e), 0.0)
            tops = np.maximum(tops, llr.max(axis=(1, 2), initial=0.0))
        return tops

    return _maxima(flat, keys, "weight", replicates, chunk, score)


def multivariate_maxima(results: DataFrame, replicates: int = 999, baseline_days: int = 365, max_days: int = 60, least: int = 3, least_tested: int = 10, prospective: bool = True, null: str = "isolate", seed: int = 1, chunk: int = 50) -> DataFrame:
    """replicate and top: the highest summed ratio after an organism's isolates are dealt anew to its cells.

    Whole isolates move (null 'isolate'), so that an isolate's results stay together; with 'stream' each agent's cases move on their own.
    Isolates count by pattern of results and cell; a block's share of each pattern is drawn first, as for cases.
    """
    if null not in ("isolate", "stream"):
        raise ValueError(null)
    bounded, first, last = study(results, baseline_days)
    if last is None:
        return results.sparkSession.createDataFrame([], "replicate int, top double")
    n_days, lengths = _lengths(first, last, max_days, "space-time")
    pattern = F.array_join(F.array_sort(F.collect_set(F.concat("agent", F.when(F.col("resistant"), "=1").otherwise("=0")))), "\t")
    whole = bounded.groupBy("isolate_id", "organism").agg(F.min("location").alias("location"), F.min("day").alias("day"), pattern.alias("pattern"))
    cells = whole.groupBy("organism", "location", F.datediff("day", F.lit(first)).alias("day"), "pattern").agg(F.count("*").alias("n"))
    shares = F.array_sort(F.collect_list(F.struct("pattern", "n"))).alias("patterns")
    margins = cells.groupBy("organism", "pattern").agg(F.sum("n").alias("n")).groupBy("organism").agg(shares)

    def score(group: pd.DataFrame, blocks: list, several: list[int]) -> np.ndarray:
        organism, (sizes, own) = group["organism"].iloc[0], _shares(blocks, int(group["block"].iloc[0]))
        patterns = [(p["pattern"], int(p["n"])) for p in group["patterns"].iloc[0]]
        agents = sorted({x.rsplit("=", 1)[0] for p, _ in patterns for x in p.split("\t")})
        tested, resistant = np.zeros((len(patterns), len(agents))), np.zeros((len(patterns), len(agents)))
        for k, (p, _) in enumerate(patterns):
            for x in p.split("\t"):
                agent, r = x.rsplit("=", 1)
                tested[k, agents.index(agent)] += 1
                resistant[k, agents.index(agent)] += r == "1"
        counts = np.array([n for _, n in patterns])
        all_tested, all_cases = counts @ tested, counts @ resistant
        slots, (at, n) = group["n"].to_numpy(), _grid(group, group["day"], n_days)
        places, known = np.repeat(at, slots), {p: k for k, (p, _) in enumerate(patterns)}
        own_tested = np.stack([_counted(at, tested[[known[p] for p in group["pattern"]], a] * slots, n, n_days).ravel() for a in range(len(agents))], axis=1)
        if null == "stream":
            in_block = np.array([sum(tested[known[p["pattern"]]] * p["_n"] for p in b["parts"]) for b in blocks]).astype(np.int64)

        def dealt(replicate: int) -> tuple[np.ndarray, np.ndarray]:
            """Tested and cases by cell and agent."""
            rng, within = _rng(seed, organism, replicate), _rng(seed, organism, replicate, own + 1)
            if null == "stream":
                mine = [rng.multivariate_hypergeometric(in_block[:, a], int(all_cases[a]))[own] for a in range(len(agents))]
                return own_tested, np.stack([within.multivariate_hypergeometric(own_tested[:, a].astype(np.int64), m) for a, m in enumerate(mine)], axis=1)
            left, mine = sizes.copy(), np.zeros(len(patterns), dtype=np.int64)
            for k, count in enumerate(counts):
                drawn = rng.multivariate_hypergeometric(left, count)
                left, mine[k] = left - drawn, drawn[own]
            moved = within.permutation(np.repeat(np.arange(len(patterns)), mine))
            table = np.bincount(places * len(patterns) + moved, minlength=n * n_days * len(patterns)).reshape(n * n_days, len(patterns))
            return table @ tested, table @ resistant

        tops, cubes = np.zeros(len(several)), []
        draws = [dealt(r) for r in several]
        for a in range(len(agents)):
            if all_tested[a] >= least_tested:
                cubes.append((a, *(_running(np.stack([d[k][:, a].reshape(n, n_days) for d in draws])) for k in (0, 1))))
        for length in lengths:
            both = cases = 0.0
            for a, t, c in cubes:
                wc, wt = _window_sums(c, length, prospective), _window_sums(t, length, prospective)
                llr = _bernoulli_llr(wc, wt, all_cases[a], all_tested[a])
                both, cases = both + np.where(llr > 1e-12, llr, 0.0), cases + np.where(llr > 1e-12, wc, 0.0)
            if cubes:
                tops = np.maximum(tops, np.where(cases >= least, both, 0.0).max(axis=(1, 2), initial=0.0))
        return tops

    return _maxima(cells.join(margins, "organism"), ["organism"], "n", replicates, chunk, score, "pattern" if null == "stream" else None)


def ranked(found: DataFrame, maxima: DataFrame, replicates: int, report: float = 0.05) -> DataFrame:
    """found with p_value = (1 + maxima at least as high) / (replicates + 1), where it is at most `report`, and recurrence_days."""
    tops = maxima.agg(F.array_sort(F.collect_list("top")).alias("_tops"))  # as many numbers as replicates
    p = (1 + F.size(F.filter("_tops", lambda t: t >= F.col("llr") - 1e-12))) / F.lit(replicates + 1.0)
    return found.join(F.broadcast(tops)).withColumn("p_value", p).drop("_tops").where(F.col("p_value") <= report).withColumn("recurrence_days", 1 / F.col("p_value"))


def non_overlapping(found: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The windows (keys, location, begin, end) that a greedy choice takes: in `order`, each that overlaps none taken before of its stream and location.

    In rounds: a window that comes before all others that share a day with it is taken, and those that share a day with
    it go. That is the greedy choice, as nothing before such a window could have barred it. order must tell windows apart; equal
    ones are told apart by begin and end. A round is a grouping by day; windows of other streams or locations never meet.
    """
    group = [*keys, "location"]
    rank = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.col("begin").alias("b"), F.col("end").alias("e"))
    left = written(found.withColumn("_rank", rank), "windows")
    taken: list[DataFrame] = []
    while not left.isEmpty():
        days = left.select(*group, "_rank", F.explode(F.sequence("begin", "end")).alias("_day"))
        first = days.groupBy(*group, "_day").agg(F.min("_rank").alias("_first"))
        met = days.join(first, [*group, "_day"])
        best = written(met.groupBy(*group, "_rank").agg(F.bool_and(F.col("_rank") == F.col("_first")).alias("_best")).where("_best").drop("_best"), "best")
        taken.append(left.join(best, [*group, "_rank"], "left_semi"))
        barred = days.join(best.select(*group, F.explode(F.sequence("_rank.b", "_rank.e")).alias("_day")).distinct(), [*group, "_day"], "left_semi").select(*group, "_rank").distinct()
        left = written(left.join(barred, [*group, "_rank"], "left_anti"), "windows")
    return reduce(DataFrame.unionByName, taken, left).select(*found.columns)
