"""Delays against reruns at each cut, endpoints, and places."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from resistrum.operators import benchmarking, places, scans, signals

DAY = datetime.date(2026, 1, 1)


def on(k):
    return DAY + datetime.timedelta(days=int(k))


def test_cuts_equal_reruns(spark):
    rng = np.random.default_rng(3)
    rows = [(s, f"L{k}", on(d), int(n := rng.integers(1, 6)), int(rng.binomial(n, 0.9 if k == 1 and d >= 14 else 0.3))) for s in "ab" for k in range(3) for d in range(22) if d not in (7, 8, 15) and rng.random() < 0.9]
    d = spark.createDataFrame(rows, "signal string, location string, day date, tested int, cases int")
    got = {(r.cut, r.signal, r.location, r.begin, r.end): (r.observed, r.tested, round(r.llr, 9)) for r in benchmarking.bernoulli_at_cuts(d, "signal").collect()}
    want = {}
    for cut in range(22):
        part = d.where(F.col("day") <= F.lit(on(cut)))
        want |= {(on(cut), r.signal, r.location, r.begin, r.end): (r.observed, r.tested, round(r.llr, 9)) for r in scans.bernoulli(part, ["signal"]).collect()}
    assert got == want and len({k[0] for k in got}) > 10
    o = spark.createDataFrame([("x", "a", "a", "L1", on(14), on(21)), ("y", "b", "b", "L9", on(3), on(9)), ("z", "b", "b", "L1", on(15), on(16))], "outbreak_id string, organism string, organism_code string, ward string, begin date, end date")
    found = benchmarking.bernoulli_at_cuts(d, "signal")
    for stride in (1, 3):
        plain = {}
        for r in o.collect():
            cuts = [r.begin + datetime.timedelta(days=stride * k) for k in range(60)]
            hits = [c for c in cuts if any(k[0] == c and k[1] == r.organism and k[2] == r.ward and k[3] <= min(r.end, c) and k[4] >= r.begin and v[2] > 1.0 for k, v in want.items())]
            plain[r.outbreak_id] = (min(hits) - r.begin).days if hits else None
        assert {r.outbreak_id: r.delay for r in benchmarking.delays(found, o, 1.0, stride).collect()} == plain and plain["x"] is not None and plain["y"] is None
    assert benchmarking.bernoulli_at_cuts(d.limit(0), "signal").count() == 0


def test_evidence_and_alerts(spark):
    d = spark.createDataFrame([("ewma", 9.0, 2.0), ("farrington", 3.0, None), ("multivariate", 4.0, None), ("unknown", 1.0, 1.0), ("pace", 1.0, 1.0)], "detector string, llr double, chart_exceedance double")
    scored = d.withColumn("evidence", benchmarking.evidence(d))
    assert {r.detector: r.evidence for r in scored.collect()} == {"ewma": 2.0, "farrington": 0.0, "multivariate": 4.0, "unknown": None, "pace": 0.0}
    t = spark.createDataFrame([("ewma", 2.0), ("multivariate", 3.9), ("farrington", float("-inf"))], "detector string, threshold double")
    assert sorted(r.detector for r in benchmarking.admitted(scored, t, "detector").collect()) == ["farrington", "multivariate"]


def test_outcomes_and_endpoints(spark):
    s = [(1, 1, "KPN", "ICU", on(0), on(5)), (1, 2, "KPN", "All locations", on(0), on(3)), (1, 3, "ECO", "ICU", on(0), on(5)), (3, 9, "KPN", "ICU", on(0), on(1))]
    o = [(1, 1, "kpn", "KPN", "icu", on(4), on(9)), (1, 2, "kpn", "KPN", "W2", on(2), on(3)), (2, 1, "eco", "ECO", "ICU", on(0), on(9))]
    sd = spark.createDataFrame(s, "cell int, signal_id int, organism string, location string, begin date, end date")
    od = spark.createDataFrame(o, "cell int, outbreak_id int, organism string, organism_code string, ward string, begin date, end date")
    rows = {r.cell: r for r in benchmarking.outcomes(sd, od, "cell").collect()}
    assert [(rows[c].presented, rows[c].detected, rows[c].alerted, rows[c].matched, rows[c].false_alerts, rows[c].localised) for c in (1, 2, 3)] == [(2, 2, 3, 2, 1, 1), (1, 0, 0, 0, 0, 0), (0, 0, 1, 0, 1, 0)]
    e = benchmarking.endpoints(benchmarking.outcomes(sd, od, "cell")).first()
    assert (round(e.sensitivity, 6), e.predictive_value, e.spatial_accuracy, round(e.temporal_accuracy, 6)) == (round(2 / 3, 6), 0.5, 0.5, round((2 / 10 + 2 / 4) / 2, 6)) and e.sensitivity_low < 2 / 3 < e.sensitivity_high
    none = benchmarking.endpoints(benchmarking.outcomes(sd.limit(0), od.limit(0), "cell")).collect()
    assert not none or none[0].sensitivity is None
    assert signals.matched(sd, od).count() > 0


ADDRESSES = "address_id int, country string, postal_code string, locality string, subdivision string"


def test_addresses(spark):
    postal = spark.createDataFrame([("GBR", "EC1Y", "Finsbury", 51.5, -0.1, 2), ("GBR", "EC1Y", "Barbican", 51.6, -0.2, 1), ("GBR", "EC", "City", 1.0, 1.0, 1), ("IND", "110001", "Delhi", 28.6, 77.2, 1)], "country string, code string, place string, latitude double, longitude double, position int")
    localities = spark.createDataFrame([("IND", "Pune", 18.5, 73.8, 300), ("IND", "Puneeth Nagar", 1.0, 1.0, 5), ("IND", "Old Pune", 2.0, 2.0, 900), ("IND", "Straße", 3.0, 3.0, 1), ("USA", "Pune", 4.0, 4.0, 1), ("IND", "Pune", 9.0, 9.0, 100)], "country string, place string, latitude double, longitude double, population int")
    subs = spark.createDataFrame([("IND", "IN-MH", 19.0, 75.0)], "country string, code string, latitude double, longitude double")
    countries = spark.createDataFrame([("IND", 20.0, 78.0), ("GBR", 54.0, -2.0)], "country string, latitude double, longitude double")
    rows = [(1, "GBR", "ec1y 8sy", None, None), (2, "GBR", "E", "x", None), (3, "IND", "999999", " PUNE ", None), (4, "IND", None, "zz", " in-mh"), (5, "IND", "", None, None), (6, "XXX", "1", "Pune", None), (7, "USA", "1", "une", None), (8, "USA", None, None, None), (9, "IND", None, "STRASSE", None), (10, None, None, None, None), (11, "GBR", "EC9", None, None)]
    got = {r.address_id: (r.latitude, r.precision, r.n_candidates, r.postal_code_unknown, r.available) for r in places.resolved(spark.createDataFrame(rows, ADDRESSES).withColumn("place", F.lit("clash")), postal, localities, subs, countries).collect()}
    assert got == {
        1: (51.6, "postal_area", 2, False, True), 2: (54.0, "country", 0, True, True), 3: (18.5, "locality", 4, True, True), 4: (19.0, "subdivision", 0, False, True), 5: (20.0, "country", 0, False, True), 6: (None, None, 0, False, False),
        7: (4.0, "locality", 1, False, True), 8: (None, None, 0, False, True), 9: (3.0, "locality", 1, False, True), 10: (None, None, 0, False, False), 11: (1.0, "postal_area", 1, False, True),
    }
    assert places.resolved(spark.createDataFrame([], ADDRESSES), postal, localities, subs, countries).count() == 0


def _most_rows(df):
    """The most rows that an operator of df's plan gives, after it ran."""
    df.collect()
    nodes, most = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        children, rows = node.children(), node.metrics().get("numOutputRows")
        nodes += [children.apply(k) for k in range(children.size())]
        most = max(most, rows.get().value() if rows.isDefined() else 0)
    return most


def test_places_of_a_code_or_a_name_are_not_paired_with_addresses(spark):
    n = 400
    addresses = spark.range(n).select(F.col("id").cast("int").alias("address_id"), F.lit("A").alias("country"), F.when(F.col("id") % 2 == 0, "AB1").alias("postal_code"), F.lit("town").alias("locality"), F.lit(None).cast("string").alias("subdivision"))
    postal = spark.range(n).select(F.lit("A").alias("country"), F.lit("AB").alias("code"), F.lit("p").alias("place"), (F.col("id") % 90).cast("double").alias("latitude"), F.lit(1.0).alias("longitude"), (-F.col("id")).alias("position"))
    localities = spark.range(n).select(F.lit("A").alias("country"), F.concat(F.lit("Old Town "), (F.col("id") % 3).cast("string")).alias("place"), F.col("id").cast("double").alias("latitude"), F.lit(2.0).alias("longitude"), F.col("id").alias("population"))
    found = places.resolved(addresses, postal, localities, postal.select("country", "code", "latitude", "longitude").limit(0), postal.select("country", "latitude", "longitude").limit(0))
    assert {(r.precision, r.latitude, r.n_candidates) for r in found.collect()} == {("postal_area", float((n - 1) % 90), n), ("locality", float(n - 1), places.MOST_PLACES)}
    assert _most_rows(found) <= 4 * n


def test_units(spark):
    names = "country string, level int, code string, parent_code string, name string"
    d = spark.createDataFrame([("IND", 1, "MH", None, "Maharashtra"), ("IND", 2, "PU", "MH", "Pune"), ("IND", 3, "H", "PU", "Haveli"), ("USA", 1, "CA", "", "California")], names)
    assert {r.code: r.admin_path for r in places.with_paths(d).collect()} == {"MH": "IND/MH", "PU": "IND/MH/PU", "H": "IND/MH/PU/H", "CA": "USA/CA"} and places.unit_problems(d).count() == 0
    bad = spark.createDataFrame([("A", 1, "x", "y", "X"), ("A", 1, "x", None, "X"), ("A", 2, "z", "q", " "), ("A", 2, None, None, "N")], names)
    assert {(r.level, r.code, r.problem) for r in places.unit_problems(bad).collect()} == {(1, "x", "parent at the top"), (1, "x", "twice"), (2, "z", "parent is not there"), (2, "z", "no name"), (2, None, "no code"), (2, None, "no parent")}


@pytest.mark.parametrize(("new", "old", "want"), [("locality", None, True), ("locality", "", True), ("locality", "country", True), ("country", "locality", False), ("x", "country", False), ("x", "y", True), ("street", "street", True)])
def test_precision(spark, new, old, want):
    d = spark.createDataFrame([(new, old)], "a string, b string")
    assert d.select(places.at_least_as_precise(F.col("a"), F.col("b"))).first()[0] is want


def test_names(spark):
    d = spark.createDataFrame([("  São \t Paulo ",), ("STRASSE",), ("Straße",), (None,)], "n string").select(places.normal_name("n").alias("n")).collect()
    assert [r.n for r in d] == ["são paulo", "strasse", "strasse", None]
