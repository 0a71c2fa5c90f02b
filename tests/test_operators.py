"""Small tables with known answers."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from resistrum.functions import clinical, distributions, stats
from resistrum.operators import cohort, detection, federated, rules, susceptibility
from resistrum.plans import analysis

DAY = dt.date(2026, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_rolling_episodes_count_from_the_last_kept_event(spark):
    e = spark.createDataFrame([(1, 7, "s", day(0)), (2, 7, "s", day(10)), (3, 7, "s", day(45)), (4, 7, "s", day(20))], "event_id long, patient long, signal string, day date")
    assert sorted(r.event_id for r in cohort.episodes(e, 30).collect()) == [1, 3]


def test_first_isolates_keep_rows_without_patient(spark):
    rows = [(1, 1, 5, "o", day(3)), (2, 1, 5, "o", day(1)), (3, 1, None, "o", day(1)), (4, 1, None, "o", day(1)), (5, 1, 5, None, day(0)), (6, 1, 5, "o", None)]
    got = cohort.first_isolates(spark.createDataFrame(rows, "isolate_id long, site long, patient long, organism string, specimen_date date"))
    assert sorted(r.isolate_id for r in got.collect()) == [2, 3, 4, 5]


def test_indicator_by_name(spark):
    rows = [(1, "Staphylococcus aureus", "FOX", "R"), (1, "Staphylococcus aureus", "VAN", "S"), (2, "Staphylococcus aureus", "FOX", "S"), (3, "Staphylococcus epidermidis", "FOX", "R"), (4, "Escherichia coli", "CTX", "I"), (5, "Staphylococcus aureus", "FOX", "R")]
    got = {r.label: (r.numerator, r.denominator) for r in susceptibility.indicators(spark.createDataFrame(rows, "isolate_id long, organism string, agent string, result string")).collect()}
    assert got == {"MRSA among Staphylococcus aureus": (2, 3), "3GC-nonsusceptible Escherichia coli": (1, 1)}


def test_wilson_and_likelihoods(spark):
    low, high = stats.wilson(F.lit(8), F.lit(16))
    assert one(spark, low) == pytest.approx(0.2799, abs=1e-4) and one(spark, high) == pytest.approx(0.7201, abs=1e-4)
    assert one(spark, stats.wilson(F.lit(0), F.lit(0))[0]) == 0
    assert one(spark, stats.llr_space_time(F.lit(6), F.lit(2.0), F.lit(20))) == pytest.approx(6 * math.log(3) + 14 * math.log(14 / 18))
    assert one(spark, stats.llr_bernoulli(F.lit(1), F.lit(10), F.lit(9), F.lit(20))) == 0
    assert one(spark, stats.llr_poisson(F.lit(5), F.lit(10.0), F.lit(10), F.lit(100.0))) == pytest.approx(5 * math.log(5) + 5 * math.log(5 / 9))
    assert one(spark, stats.percent(F.lit(1), F.lit(0))) is None


def test_risk_is_null_when_a_part_is_missing(spark):
    score, rating = stats.risk_rating(F.lit(9), F.lit(5), F.lit(5), F.lit(5), F.lit(5))
    assert (one(spark, score), one(spark, rating)) == (5.0, "critical")
    score, rating = stats.risk_rating(F.lit(1), F.lit(None), F.lit(1), F.lit(1), F.lit(1))
    assert (one(spark, score), one(spark, rating)) == (None, None)


def test_breakpoints_prefer_the_specific_and_refuse_the_ambiguous(spark):
    ast = spark.createDataFrame([(1, "o", "a", "blood", "in", 4.0), (2, "o", "a", "urine", "in", 4.0), (3, "o", "b", "blood", "in", 4.0), (4, "x", "a", "blood", "in", 4.0)], "id long, organism string, agent string, specimen string, location_type string, measurement double")
    b = [("o", "a", None, None, 1.0, 2.0), ("o", "a", "blood", None, 4.0, 8.0), ("o", "b", None, None, 1.0, 2.0), ("o", "b", None, None, 2.0, 2.0)]
    got = {r.id: r.reading for r in rules.with_breakpoints(ast, spark.createDataFrame(b, "organism string, agent string, specimen string, location_type string, s double, r double"), ["id"]).collect()}
    assert got == {1: "S", 2: "R", 3: None, 4: None}


def test_criteria(spark):
    d = spark.createDataFrame([(1, {"A": "R", "B": "I"}), (2, {"A": "R"}), (3, {"C": "S"})], "id long, results map<string,string>")
    assert sorted(r.id for r in d.where(rules.criteria("A=R AND B=NS OR C=S")).collect()) == [1, 3]
    with pytest.raises(ValueError):
        rules.criteria("A=Q")


def test_scope_fails_closed(spark):
    d = spark.createDataFrame([(1, "W/1"), (2, "W/1/5"), (3, "W/12")], "site long, admin_path string")
    pick = lambda *a: sorted(r.site for r in d.where(federated.scope(*a)).collect())
    assert (pick("state", "W/1"), pick("global", None), pick("planet", "W"), pick("site", None)) == ([1, 2], [1, 2, 3], [], [])
    assert federated.floor_of(1) == 5


def test_dates_numbers_and_text(spark):
    assert one(spark, clinical.parsed_date(F.lit("31/12/2025"))) == dt.date(2025, 12, 31)
    assert one(spark, clinical.parsed_date(F.lit("20250230"))) is None
    assert one(spark, clinical.strict_number(F.lit("<= 0,5"))) == 0.5
    assert one(spark, clinical.strict_number(F.lit("5 mm"))) is None
    assert one(spark, clinical.interpretation(F.lit(" sdd "))) == "I"
    assert one(spark, clinical.interpreted(F.lit(16.0), F.lit("DISK"), F.lit(18.0), F.lit(15.0))) == "I"
    assert one(spark, clinical.redacted(F.lit("seen 2025-01-02, a.b@c.org"))) == "seen [DATE], [EMAIL]"
    assert one(spark, clinical.spreadsheet_safe(F.lit("-x"))) == "'-x" and one(spark, clinical.spreadsheet_safe(F.lit("-1.5"))) == "-1.5"
    year, week = clinical.mmwr_week(F.lit("2026-01-03").cast("date"))
    assert (one(spark, year), one(spark, week)) == (2025, 53)


def test_daily_series_has_zeros_and_a_pool(spark):
    e = spark.createDataFrame([("A", "s", day(0)), ("B", "s", day(2))], "location string, signal string, day date")
    got = {(r.location, (r.day - DAY).days): r.cases for r in detection.daily(e).collect()}
    assert got == {("A", 0): 1, ("A", 1): 0, ("A", 2): 0, ("B", 0): 0, ("B", 1): 0, ("B", 2): 1, (detection.POOLED, 0): 1, (detection.POOLED, 1): 0, (detection.POOLED, 2): 1}


def test_scan_finds_a_planted_cluster(spark):
    rows = [(i, "s", f"L{i % 5}", day(i % 60)) for i in range(300)] + [(1000 + i, "s", "L3", day(57 + i % 3)) for i in range(20)]
    found = detection.scan(spark.createDataFrame(rows, "event_id long, signal string, location string, day date"), replicates=39).collect()
    assert found and found[0].location == "L3" and found[0].p_value == pytest.approx(1 / 40)


def test_farrington_alarms_on_a_jump(spark):
    rows = [("A", "s", day(7 * k), 10 + k % 3) for k in range(312)] + [("A", "s", day(7 * 312), 60)]
    got = detection.farrington(spark.createDataFrame(rows, "location string, signal string, day date, cases long")).where("alarm").collect()
    assert [r.cases for r in got] == [60] and got[0].expected == pytest.approx(11, abs=1)


def test_farrington_drops_a_trend_that_tells_nothing():
    assert detection._two_sided(2.0, 1) == pytest.approx(0.2951672, abs=1e-6)
    assert detection._two_sided(2.2281389, 10) == pytest.approx(0.05, abs=1e-6)
    assert detection._two_sided(2.0345153, 33) == pytest.approx(0.05, abs=1e-6)
    own = pd.DataFrame({"location": "A", "signal": "s", "day": [day(7 * k) for k in range(313)], "cases": [8 + (k * 7) % 5 for k in range(313)]})
    got = detection._farrington(own, 5, 3, 52, 2.576).iloc[-1]
    ref = [own["cases"][312 - 52 * b + d] for b in range(1, 6) for d in range(-3, 4)]
    b, _, _ = written_out(np.ones((35, 1)), np.array(ref, dtype=float))
    assert not got.trend and got.expected == pytest.approx(float(np.exp(b[0])), rel=1e-7)


def one_fit(x, y, w):
    """A weighted log-linear Poisson fit by matrices: coefficients, covariance without dispersion, means, dispersion."""
    mu = y + 0.1
    for _ in range(100):
        k, z = w * mu, np.log(mu) + (y - mu) / mu
        b = np.linalg.solve((x.T * k) @ x, (x.T * k) @ z)
        mu = np.exp(x @ b)
    cov = np.linalg.inv((x.T * (w * mu)) @ x)
    return b, cov, mu, (w * (y - mu) ** 2 / mu).sum() / (len(y) - x.shape[1])


def written_out(x, y):
    """The reweighted fit: coefficients, covariance, dispersion."""
    w = np.ones(len(y))
    _, cov, mu, phi = one_fit(x, y, w)
    hat = mu * np.einsum("ij,jk,ik->i", x, cov, x)
    r = 1.5 * (y ** (2 / 3) * mu ** (-1 / 6) - np.sqrt(mu)) / np.sqrt(max(phi, 1) * (1 - hat))
    w = np.array([v**-2 if v > 1 else 1.0 for v in r])
    b, cov, _, phi = one_fit(x, y, w * len(w) / w.sum())
    return b, cov, phi


@pytest.mark.parametrize("seed", range(3))
def test_farrington_numbers_are_those_of_single_fits(spark, seed):
    rng = np.random.default_rng(seed)
    mean = 6 * np.exp(0.004 * np.arange(330) * (seed != 1)) * (1 + 0.5 * np.sin(np.arange(330) / 52 * 2 * np.pi))
    cases = rng.negative_binomial(8, 8 / (8 + mean))
    own = pd.DataFrame({"location": "A", "signal": "s", "day": [day(7 * k) for k in range(330)], "cases": cases})
    got = detection._farrington(own, 5, 3, 52, 2.5758293035489004)
    assert len(got) == 330 - 52 and set(got["trend"]) == ({True, False} if seed != 1 else set(got["trend"])) and got["n_references"].max() == 35
    for t in (52, 60, 200, 290, 329):
        ref = [k for back in range(5, 0, -1) for k in range(t - 52 * back - 3, t - 52 * back + 4) if k >= 0]
        y, x = cases[ref].astype(float), np.column_stack([np.ones(len(ref)), (np.array(ref) - t) / 52])
        b, cov, phi = written_out(x, y)
        p = detection._two_sided(b[1] / np.sqrt(phi * cov[1, 1]), len(ref) - 2)
        trend = p < 0.05 and np.exp(b[0]) <= y.max()
        b, cov, phi = (b, cov, phi) if trend else written_out(x[:, :1], y)
        mu, phi = np.exp(b[0]), max(phi, 1)
        row = got.loc[t]
        assert row["trend"] == trend and row["n_references"] == len(ref) and row["expected"] == pytest.approx(mu, rel=1e-7) and row["dispersion"] == pytest.approx(phi, rel=1e-6)
        assert row["upper"] == pytest.approx((mu ** (2 / 3) + 2.5758293035489004 * np.sqrt(4 / 9 * mu ** (1 / 3) * (phi + phi * cov[0, 0] * mu))) ** 1.5, rel=1e-6)


def test_farrington_with_a_bound_of_counts(spark):
    rng = np.random.default_rng(7)
    rows = [("A", "s", day(7 * k), int(c)) for k, c in enumerate(rng.negative_binomial(4, 0.3, 300))] + [("B", "s", day(7 * k), int(k % 20 == 0)) for k in range(300)] + [("C", "s", day(7 * k), int(k == 3)) for k in range(300)]
    d = spark.createDataFrame(rows, "location string, signal string, day date, cases long")
    got = {(r.location, r.day): r for r in detection.farrington(d, bound="negative-binomial").collect()}
    assert {k[0] for k in got} == {"A", "B"} and not any(r.alarm for k, r in got.items() if k[0] == "B")

    def below(k, size, mean):
        return sum(math.exp(math.lgamma(i + size) - math.lgamma(size) - math.lgamma(i + 1) + size * math.log(size / (size + mean)) + i * math.log(mean / (size + mean))) for i in range(int(k) + 1))

    r = got["A", day(7 * 299)]
    size = r.expected / (r.dispersion - 1)
    assert below(r.upper, size, r.expected) >= 0.995 > below(r.upper - 1, size, r.expected) and r.probability == pytest.approx(1 - below(r.cases - 1, size, r.expected), abs=1e-9)
    power = {(r.location, r.day): r for r in detection.farrington(d).collect()}["A", day(7 * 299)]
    assert power.expected == r.expected and 0 <= power.probability <= 1


def test_farrington_alarms_counts_weeks_without_cases(spark, monkeypatch):
    # a case every fourth week for six years, then eight in one week
    rows = [(7 * k) for k in range(0, 312, 4)] + [7 * 312] * 8
    e = spark.createDataFrame([("org", day(n)) for n in rows], "organism string, specimen_date date")
    monkeypatch.setattr(analysis.adapters, "ast", lambda *_: e)
    got = analysis.farrington_alarms(spark, "").where("alarm").collect()
    assert [(r.location, r.cases, r.alarm) for r in got] == [("all", 8, True)] and got[0].expected < 1


def test_scans_take_the_settings_of_the_reference(spark, monkeypatch):
    rows = [(k, "s", "L1" if k % 5 else "L2", k, day(k % 120)) for k in range(240)] + [(500 + k, "s", "L2", k, day(100 + k % 20)) for k in range(20)]
    e = spark.createDataFrame(rows, "event_id long, signal string, location string, patient long, day date")
    monkeypatch.setattr(analysis.adapters, "events", lambda *_: e)
    assert analysis.bayesian_windows(spark, "").agg(F.max("days")).first()[0] == 30
    got = {r.location: r for r in analysis.scan_clusters(spark, "").collect()}
    assert got["L2"].days > 14 and got["L2"].p_value < 0.01


def test_empty_tables(spark):
    e = spark.createDataFrame([], "event_id long, signal string, location string, patient long, day date")
    assert detection.prospective_windows(e).count() == cohort.episodes(e).count() == 0
    ast = spark.createDataFrame([], "isolate_id long, organism string, agent string, result string")
    assert susceptibility.rates(ast, "agent").count() == susceptibility.indicators(ast).count() == 0


def test_names_are_compared_without_case(spark):
    rows = [(1, "L1", "P1", "E. coli", "2026-01-02"), (2, "l1 ", "p1", "e. COLI", "2026-01-01"), (3, "L1", " ", "E. coli", "2026-01-01"), (4, "L1", None, "E. coli", "2026-01-01")]
    d = spark.createDataFrame(rows, "isolate_id long, site string, patient string, organism string, specimen_date string")
    assert sorted(r.isolate_id for r in cohort.first_isolates(d).collect()) == [2, 3, 4]


def test_origin_phenotypes_and_redaction(spark):
    day = F.lit("2026-01-09").cast("date")
    assert one(spark, clinical.infection_origin(F.lit(" IN"), F.lit("2026-01-01").cast("date"), day)) == "Hospital"
    assert one(spark, clinical.infection_origin(F.lit("Out"), day, day)) == "Community"
    assert one(spark, clinical.phenotype(F.lit("Carbapenems"), F.lit(None).cast("string"), F.lit("MEM"))) == "carbapenem-R"
    assert one(spark, clinical.phenotype(F.lit("carbapenem mix"), F.lit("Tetracyclines"), F.lit("X"))) == "tetracycline-R"
    assert one(spark, clinical.phenotype(F.lit(None).cast("string"), F.lit("tetracyclines old"), F.lit("X"))) == "X"
    assert one(spark, clinical.redacted(F.lit("Patient name: Ann; AB12345, 040 123 4567"))) == "[IDENTIFIER]; [ID], [PHONE]"


def test_country_without_value_is_all(spark):
    d = spark.createDataFrame([("1", "W/1")], "site string, admin_path string")
    assert [d.where(federated.scope(level, None)).count() for level in ("Country", "", "GLOBAL", "site", "admin:1")] == [1, 1, 1, 0, 0]


def test_null_maxima_are_those_of_shuffled_days(spark):
    """Drawn counts and shuffled cases give the same distribution of maxima."""
    rnd = np.random.default_rng(3)
    rows = [(i, f"s{i % 2}", f"L{int(rnd.integers(4))}", dt.date(2025, 1, 1) + dt.timedelta(days=int(rnd.integers(28)))) for i in range(400)]
    d = spark.createDataFrame(rows, "event_id long, signal string, location string, day date")
    drawn = sorted(r.top for r in detection.null_maxima(d, 200).collect())
    shuffled = detection.prospective_windows(detection.permuted(d, 200), 14, 3, "replicate").groupBy("replicate").agg(F.max("llr").alias("top"))
    brute = sorted(r.top for r in shuffled.collect())
    assert len(drawn) == 200
    assert max(abs(np.searchsorted(drawn, x) / 200 - (k + 1) / len(brute)) for k, x in enumerate(brute)) < 0.17
    again = sorted(r.top for r in detection.null_maxima(d, 200, chunk=7).collect())
    assert again == drawn


def test_daily_reads_events_once(spark):
    """A study's days and sums over locations are made of the counts, not of the events anew."""
    read = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            read.add(len(f))
            yield f

    rows = [("A", "s", dt.date(2026, 1, 1 + k % 5)) for k in range(20)] + [("B", "s", dt.date(2026, 1, 2)), ("B", "t", None)]
    events = spark.createDataFrame(rows, "location string, signal string, day date").mapInPandas(seen, "location string, signal string, day date")
    got = {(r.location, r.signal, r.day.day): r.cases for r in detection.daily(events).where("signal = 's'").collect()}
    assert read.value == len(rows)
    assert got == {("A", "s", d): 4 for d in range(1, 6)} | {("B", "s", d): int(d == 2) for d in range(1, 6)} | {("All locations", "s", d): 4 + (d == 2) for d in range(1, 6)}


def test_weeks_are_dealt_over_tasks(spark):
    """The folds of one series' weeks don't meet in one task, and a quantile's fold takes no more steps than its probability needs."""
    weeks = spark.createDataFrame([("all", "s", dt.date(2016, 1, 3) + dt.timedelta(weeks=k), 20 + k % 7) for k in range(400)], "location string, signal string, day date, cases long")
    found = detection.farrington(weeks, bound="negative-binomial")
    assert sum(n > 0 for n in found.rdd.glom().map(len).collect()) > 32
    mean, sd, p = F.lit(100.0), F.lit(10.0), F.lit(0.995)
    assert spark.range(1).select(distributions._last(mean, sd, p)).first()[0] < 320
    many = spark.createDataFrame([(m, s) for m in (0.3, 4.0, 250.0, 3000.0) for s in (0.01, 0.5, 20.0)], "m double, s double")
    for q in (0.005, 0.5, 0.995, 0.99999):
        for r in many.select("m", "s", distributions.negative_binomial_quantile(F.lit(q), F.col("s"), F.col("m")).alias("k")).withColumn("at", distributions.negative_binomial_probability(F.col("k"), F.col("s"), F.col("m"))).withColumn("below", distributions.negative_binomial_probability(F.col("k") - 1, F.col("s"), F.col("m"))).collect():
            if q <= 0.995 or r.s >= 0.5:
                assert r.at >= q - 1e-9 and r.below < q + 1e-9, r
