"""Scans, their null draws, choices in rounds, and signals, against plain Python."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from resistrum.operators import scans, signals

DAY = datetime.date(2026, 1, 1)


def on(k):
    return DAY + datetime.timedelta(days=int(k))


def cells(spark, seed=1, n_days=24, locations=4, boost=True):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("a", "b"):
        for loc in range(locations):
            for d in range(n_days):
                tested = int(rng.integers(0, 6))
                cases = int(rng.binomial(tested, 0.8 if boost and s == "a" and loc == 1 and d >= n_days - 4 else 0.3))
                if tested:
                    rows.append((s, f"L{loc}", on(d), tested, cases))
    return rows, spark.createDataFrame(rows, "signal string, location string, day date, tested int, cases int")


def bernoulli(c, n, cc, nn):
    xlogy = lambda x, y: x * np.log(x / y) if x > 0 else 0.0
    if n <= 0 or n >= nn or cc <= 0 or cc >= nn or c / n <= (cc - c) / (nn - n):
        return 0.0
    return xlogy(c, n) + xlogy(n - c, n) + xlogy(cc - c, nn - n) + xlogy(nn - n - cc + c, nn - n) - xlogy(cc, nn) - xlogy(nn - cc, nn)


def plain_windows(rows, prospective, n_days=24, max_days=60):
    out = {}
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        cc, nn = sum(r[4] for r in own), sum(r[3] for r in own)
        for loc in {r[1] for r in own}:
            for end in [n_days - 1] if prospective else range(n_days):
                for length in range(1, min(max_days, n_days // 2, end + 1) + 1):
                    inside = [r for r in own if r[1] == loc and on(end - length + 1) <= r[2] <= on(end)]
                    c, n = sum(r[4] for r in inside), sum(r[3] for r in inside)
                    if c >= 3 and n >= 10 and (llr := bernoulli(c, n, cc, nn)) > 1e-12:
                        out[s, loc, on(end - length + 1), on(end)] = (c, n, round(llr, 9))
    return out


@pytest.mark.parametrize("prospective", [True, False])
def test_windows_of_proportions(spark, prospective):
    rows, d = cells(spark)
    got = scans.bernoulli(d.withColumn("begin", F.lit("clash")), ["signal"], prospective=prospective).collect()
    assert {(r.signal, r.location, r.begin, r.end): (r.observed, r.tested, round(r.llr, 9)) for r in got} == plain_windows(rows, prospective)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "signal string, location string, day date, tested int, cases int")
    people = spark.createDataFrame([], "location string, day date, population double")
    for shape in scans.SHAPES:
        assert scans.bernoulli(none, ["signal"], shape).count() == 0 and scans.poisson(none, people, ["signal"], shape).count() == 0
    assert scans.bernoulli_maxima(none, ["signal"], 19).count() == 0 and scans.poisson_maxima(none, people, ["signal"], 19).count() == 0
    assert scans.space_time(none).count() == 0
    assert scans.non_overlapping(scans.bernoulli(none, ["signal"]), ["signal"], [F.col("llr")]).count() == 0


def shuffled_maxima(rows, replicates, seed=9):
    """Maxima after labels of cases are shuffled among the tested, by brute force."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(replicates):
        new = []
        for s in ("a", "b"):
            own = [r for r in rows if r[0] == s]
            labels = np.repeat([1, 0], [sum(r[4] for r in own), sum(r[3] - r[4] for r in own)])
            parts = np.split(rng.permutation(labels), np.cumsum([r[3] for r in own])[:-1])
            new += [(*r[:4], int(p.sum())) for r, p in zip(own, parts, strict=True)]
        out.append(max((v[2] for v in plain_windows(new, True).values()), default=0.0))
    return np.array(out)


@pytest.mark.parametrize("block", [10**6, 20], ids=["one block", "blocks"])
def test_null_of_proportions(spark, monkeypatch, block):
    monkeypatch.setattr(scans, "BLOCK_CELLS", block)
    rows, d = cells(spark)
    got = np.sort([r.top for r in scans.bernoulli_maxima(d, ["signal"], 400, chunk=100).collect()])
    want = np.sort(shuffled_maxima(rows, 400))
    assert len(got) == 400 and np.abs(np.quantile(got, [0.25, 0.5, 0.75]) - np.quantile(want, [0.25, 0.5, 0.75])).max() < 0.45
    again = np.sort([r.top for r in scans.bernoulli_maxima(d.repartition(3), ["signal"], 400, chunk=37).collect()])
    assert np.allclose(got, again)
    found = scans.ranked(scans.bernoulli(d, ["signal"]), scans.bernoulli_maxima(d, ["signal"], 400), 400).orderBy(F.desc("llr")).first()
    assert (found.signal, found.location) == ("a", "L1") and found.p_value == (1 + (got >= found.llr - 1e-12).sum()) / 401


def test_rates_and_their_null(spark):
    rows, d = cells(spark)
    people = [(f"L{k}", on(t), 10.0 + 5 * k) for k in range(3) for t in range(24)]
    population = spark.createDataFrame(people, "location string, day date, population double")
    got = {(r.signal, r.location, r.begin): r for r in scans.poisson(d, population, ["signal"]).collect()}
    total = sum(p[2] for p in people)
    for (s, loc, begin), r in got.items():
        kept = [x for x in rows if x[0] == s and x[1] != "L3"]
        cc, c = sum(x[4] for x in kept), sum(x[4] for x in kept if x[1] == loc and x[2] >= begin)
        e = cc * sum(p[2] for p in people if p[0] == loc and p[1] >= begin) / total
        assert r.observed == c and abs(r.expected - e) < 1e-9 and abs(r.llr - (c * np.log(c / e) + (cc - c) * np.log((cc - c) / (cc - e)))) < 1e-9
    assert got and scans.orphans(d, population).select("location").distinct().collect()[0][0] == "L3"
    tops = np.array([r.top for r in scans.poisson_maxima(d, population, ["signal"], 300, chunk=100).collect()])
    rng, want = np.random.default_rng(4), []
    for _ in range(300):
        best = 0.0
        for s in ("a", "b"):
            kept = [x for x in rows if x[0] == s and x[1] != "L3" and x[4] > 0]
            w = np.array([10.0 + 5 * int(x[1][1]) for x in kept])
            drawn, cc = rng.multinomial(sum(x[4] for x in kept), w / w.sum()), sum(x[4] for x in kept)
            for loc in range(3):
                for length in range(1, 13):
                    c = sum(n for n, x in zip(drawn, kept, strict=True) if x[1] == f"L{loc}" and x[2] >= on(24 - length))
                    e = cc * length * (10.0 + 5 * loc) / total
                    if c >= 3 and e >= 0.5 and c > e:
                        best = max(best, c * np.log(c / e) + ((cc - c) * np.log((cc - c) / (cc - e)) if cc > c else 0.0))
        want.append(best)
    assert np.abs(np.quantile(tops, [0.25, 0.5, 0.75]) - np.quantile(want, [0.25, 0.5, 0.75])).max() < 0.45


def panel(spark, n=400, seed=2):
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        r = rng.random() < 0.3
        loc, d = int(rng.integers(0, 3)), int(rng.integers(0, 20))
        rows += [(i, "o", a, f"L{loc}", on(d), bool(r) if a != "C" else bool(rng.random() < 0.5)) for a in "ABC" if rng.random() < 0.8]
    return rows, spark.createDataFrame(rows, "isolate_id long, organism string, agent string, location string, day date, resistant boolean")


def combined(rows):
    out = {}
    agents = sorted({r[2] for r in rows})
    totals = {a: (sum(r[5] for r in rows if r[2] == a), sum(r[2] == a for r in rows)) for a in agents}
    for loc in sorted({r[3] for r in rows}):
        for length in range(1, 11):
            llr = cases = 0.0
            for a in agents:
                inside = [r[5] for r in rows if r[2] == a and r[3] == loc and r[4] >= on(20 - length)]
                one = bernoulli(sum(inside), len(inside), *totals[a]) if totals[a][1] >= 10 else 0.0
                if one > 1e-12:
                    llr, cases = llr + one, cases + sum(inside)
            if llr > 0 and cases >= 3:
                out[loc, length] = (int(cases), llr)
    return out


@pytest.mark.parametrize(("null", "block"), [("isolate", 10**6), ("isolate", 60), ("stream", 60)])
def test_several_streams_and_their_null(spark, monkeypatch, null, block):
    monkeypatch.setattr(scans, "BLOCK_CELLS", block)
    rows, d = panel(spark)
    got = {(r.location, r.days): (r.observed, r.llr) for r in scans.multivariate(d).collect()}
    want = combined(rows)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    tops = np.array([r.top for r in scans.multivariate_maxima(d, 200, null=null, chunk=50).collect()])
    rng, direct, by_isolate = np.random.default_rng(8), [], {}
    for r in rows:
        by_isolate.setdefault(r[0], []).append(r)
    for _ in range(200):
        new = []
        if null == "isolate":
            places = [(x[0][3], x[0][4]) for x in by_isolate.values()]
            order = rng.permutation(len(places))
            for x, k in zip(by_isolate.values(), order, strict=True):
                new += [(*r[:3], *places[k], r[5]) for r in x]
        else:
            for a in "ABC":
                own = [r for r in rows if r[2] == a]
                new += [(*r[:5], bool(x)) for r, x in zip(own, rng.permutation([r[5] for r in own]), strict=True)]
        direct.append(max((v[1] for v in combined(new).values()), default=0.0))
    assert np.abs(np.quantile(tops, [0.25, 0.5, 0.75]) - np.quantile(direct, [0.25, 0.5, 0.75])).max() < 0.7


@pytest.mark.parametrize("seed", range(3))
def test_greedy_choice_of_windows(spark, seed):
    rng = random.Random(seed)
    rows = []
    for s in "ab":
        for loc in ("x", "y"):
            for _ in range(40):
                b = rng.randrange(40)
                rows.append((s, loc, on(b), on(b + rng.randrange(8)), float(rng.randrange(6)), rng.randrange(3)))
    rows = list(dict.fromkeys(rows))
    taken = []
    for r in sorted(rows, key=lambda r: (-r[4], -r[5], r[2], r[3])):
        if not any(t[:2] == r[:2] and r[2] <= t[3] and r[3] >= t[2] for t in taken):
            taken.append(r)
    d = spark.createDataFrame(rows, "signal string, location string, begin date, end date, llr double, observed int")
    got = scans.non_overlapping(d, ["signal"], [-F.col("llr"), -F.col("observed")])
    assert sorted(map(tuple, got.collect())) == sorted(taken)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_one_to_one(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [(k, f"L{rng.randrange(3)}", b := rng.randrange(60), b + rng.randrange(1, 15), float(rng.randrange(5))) for k in range(n)]  # noqa: E731, F841
    theirs, ours = make(40), make(40)
    used, want = set(), []
    for t in sorted(theirs, key=lambda t: (-t[4], t[0])):
        near = [(abs(t[2] - o[2]) + abs(t[3] - o[3]), o[0]) for o in ours if o[1] == t[1] and t[2] <= o[3] and o[2] <= t[3] and o[0] not in used]
        if near:
            used.add(min(near)[1])
            want.append((t[0], min(near)[1], min(near)[0]))
    frame = lambda rows: spark.createDataFrame([(k, f" {loc} ", on(b), on(e), llr) for k, loc, b, e, llr in rows], "id long, location string, begin date, end date, llr double")
    assert sorted(map(tuple, signals.one_to_one(frame(theirs), frame(ours)).collect())) == sorted(want)
    assert signals.one_to_one(frame(theirs).limit(0), frame(ours)).count() == 0


def test_signals_and_truth(spark):
    s = [(1, " kpn", "icu ", on(0), on(5)), (2, "KPN", "All locations", on(4), on(9)), (3, "ECO", "ICU", on(0), on(5)), (4, "Klebsiella", "W2", on(6), on(6)), (5, None, "ICU", on(0), on(1)), (6, "KPN", "ICU", None, on(9)), (7, "KPN", None, on(0), on(9))]
    o = [(1, "Klebsiella", "KPN", "ICU", on(5), on(6)), (2, "x", "eco", "All wards", on(5), on(30)), (3, "Klebsiella", "KPN", None, on(0), on(3))]
    sd, od = spark.createDataFrame(s, "signal_id int, organism string, location string, begin date, end date"), spark.createDataFrame(o, "outbreak_id int, organism string, organism_code string, ward string, begin date, end date")
    got = {(r.signal_id, r.outbreak_id): (r.localised, r.overlap_days, round(r.jaccard, 6)) for r in signals.matched(sd, od).collect()}
    assert got == {(1, 1): (True, 1, round(1 / 7, 6)), (2, 1): (False, 2, round(2 / 6, 6)), (3, 2): (False, 1, round(1 / 31, 6))}
    assert sorted(r.signal_id for r in signals.unmatched(sd, od).collect()) == [4, 5, 6, 7]


def test_evidence_orders_within_bands_only(spark):
    rows = [("a", "alert", 2.4, 0.1, 0.01), ("b", "alert", 1.6, 0.9, 0.001), ("c", "monitor", 9.0, 1.0, 0.001), ("d", "alert", 2.6, 0.0, 0.02), ("e", "alert", 2.4, 0.1, 0.001), ("f", "alert", 2.45, 0.1, 0.03)]
    d = spark.createDataFrame(rows, "signal_id string, status string, evidence double, plausibility double, p_value double")
    assert [r.signal_id for r in d.orderBy(*signals.banded_order()).collect()] == ["d", "b", "f", "e", "a", "c"]


def test_mechanisms_take_the_worst_result(spark):
    d = spark.createDataFrame([(1, "MEM", "S"), (1, "IPM", "I"), (1, "CIP", "R"), (1, "GEN", None), (2, "MEM", "x"), (2, "IPM", "S")], "isolate_id int, agent string, result string")
    m = spark.createDataFrame([("MEM", "carbapenem"), ("IPM", "carbapenem")], "agent string, mechanism string")
    assert sorted(map(tuple, signals.pooled(d, m).collect())) == [(1, "CIP", "R"), (1, "carbapenem", "I"), (2, "carbapenem", "S")]


def test_stays_that_meet(spark):
    s = spark.createDataFrame([("x", "o", "A", "L", on(0), on(30)), ("y", "o", None, "All locations", on(0), on(30)), ("z", "q", "A", "L", on(0), on(30))], "signal_id string, organism string, agent string, location string, begin date, end date")
    c = [("O", "a", "L", on(5), on(0)), ("o", "A", "L", on(8), on(4)), ("o", "A", "L", on(29), on(27)), ("o", "A", "M", on(6), on(0)), ("o", None, "L", on(3), None), ("o", None, "M", on(3), on(9)), ("o", "A", "L", on(40), None)]
    cases = spark.createDataFrame(c, "organism string, agent string, location string, specimen_date date, admission_date date")
    got = {r.signal_id: (r.n_cases, r.plausibility) for r in signals.plausibility(s, cases).collect()}
    assert got == {"x": (3, round(2 / 3, 4)), "y": (2, 0.0), "z": (0, 0.0)}


def test_ratios_of_large_counts_are_those_of_the_sql(spark):
    import duckdb

    from resistrum.functions.stats import llr_bernoulli
    from resistrum.plans.scanning import _BERNOULLI

    rng = np.random.default_rng(5)
    rows = [(float(c), float(n), 2_300_000.0, 3_600_000.0) for n in rng.integers(3_000, 1_800_000, 400) for c in [rng.binomial(n, 0.64)]] + [(0.0, 5.0, 2.0, 9.0), (5.0, 5.0, 5.0, 9.0), (3.0, 9.0, 3.0, 9.0)]
    d = spark.createDataFrame(rows, "c double, n double, cc double, nn double")
    got = [r.llr for r in d.select(llr_bernoulli(*(F.col(x) for x in ("c", "n", "cc", "nn"))).alias("llr")).collect()]
    want = [r[0] for r in duckdb.connect().execute(f"SELECT {_BERNOULLI} FROM (SELECT c::DOUBLE AS c, n::DOUBLE AS n, cc::DOUBLE AS cc, nn::DOUBLE AS nn, k FROM (VALUES {', '.join(str((*r, k)) for k, r in enumerate(rows))}) AS t(c, n, cc, nn, k)) ORDER BY k").fetchall()]
    assert got == want
