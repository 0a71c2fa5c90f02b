"""Distributions, payloads, the catalogue of measures, calibration and audit entries."""

import json
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from resistrum.functions import distributions as D
from resistrum.functions import payload
from resistrum.operators import evaluation, metrics, screening


def values(spark, column, rows, names):
    d = spark.createDataFrame([tuple(None if x is None else float(x) for x in r) for r in rows], ", ".join(f"{n} double" for n in names))
    return [r[0] for r in d.select(column).collect()]


def test_normal(spark):
    xs = [-38, -9, -5.5, -5, -3.2, -1, -1e-6, 0, 0.3, 1.96, 4.99, 5.01, 8]
    got = values(spark, D.normal_probability(F.col("x")), [(x,) for x in xs], ["x"])
    assert all(abs(g - math.erfc(-x / math.sqrt(2)) / 2) <= 1e-9 * max(1e-300, math.erfc(-x / math.sqrt(2)) / 2) + 1e-15 for g, x in zip(got, xs, strict=True))
    ps = [1e-12, 1e-5, 0.025, 0.3, 0.5, 0.7, 0.975, 1 - 1e-9]
    got = values(spark, D.normal_quantile(F.col("p")), [(p,) for p in ps], ["p"])
    assert all(abs(g - NormalDist().inv_cdf(p)) < 1e-8 for g, p in zip(got, ps, strict=True))
    assert values(spark, D.normal_quantile(F.col("p")), [(0,), (1,), (-1,), (None,)], ["p"]) == [float("-inf"), float("inf"), None, None]
    assert abs(values(spark, D.normal_density(F.col("x")), [(1.5,)], ["x"])[0] - NormalDist().pdf(1.5)) < 1e-15


def test_gamma_and_t(spark):
    xs = [0.1, 0.5, 1, 2.5, 10, 171.3, 5000]
    assert all(abs(g - math.lgamma(x)) <= 1e-9 * max(1, abs(math.lgamma(x))) for g, x in zip(values(spark, D.log_gamma(F.col("x")), [(x,) for x in xs], ["x"]), xs, strict=True))
    # known values: quantiles of Student's distribution at 0.975 (12.706..., 2.228..., 1.984...), and df = 1, 2 in closed form
    t = [(12.706204736432095, 1, 0.975), (2.2281388519649385, 10, 0.975), (1.9839715185235518, 100, 0.975), (1, 1, 0.75), (-1, 1, 0.25), (math.sqrt(2), 2, 0.5 + math.sqrt(2) / (2 * math.sqrt(4))), (0, 7, 0.5)]
    got = values(spark, D.t_probability(F.col("t"), F.col("df")), [x[:2] for x in t], ["t", "df"])
    assert all(abs(g - x[2]) < 1e-9 for g, x in zip(got, t, strict=True))
    assert abs(values(spark, D.t_two_sided(F.col("t"), F.col("df")), [(2.2281388519649385, 10)], ["t", "df"])[0] - 0.05) < 1e-9
    # I_x(2, 3) = 6x^2 - 8x^3 + 3x^4
    for x in (0.0, 0.1, 0.5, 0.9, 1.0):
        assert abs(values(spark, D.incomplete_beta(F.lit(2), F.lit(3), F.col("x")), [(x,)], ["x"])[0] - (6 * x**2 - 8 * x**3 + 3 * x**4)) < 1e-12


def poisson(k, m):
    return sum(math.exp(i * math.log(m) - m - math.lgamma(i + 1)) for i in range(int(k) + 1)) if k >= 0 else 0.0


def binomial(k, s, m):
    return sum(math.exp(math.lgamma(i + s) - math.lgamma(s) - math.lgamma(i + 1) + s * math.log(s / (s + m)) + i * math.log(m / (s + m))) for i in range(int(k) + 1)) if k >= 0 else 0.0


def test_counts(spark):
    rows = [(0, 0.3), (3, 2.5), (120, 100), (900, 1000), (-1, 2), (2.7, 2)]
    got = values(spark, D.poisson_probability(F.col("k"), F.col("m")), rows, ["k", "m"])
    assert all(abs(g - poisson(math.floor(k), m)) < 1e-9 for g, (k, m) in zip(got, rows, strict=True))
    rows = [(0, 1.5, 0.3), (3, 0.4, 2.5), (200, 3, 100), (5, 1e6, 4)]
    got = values(spark, D.negative_binomial_probability(F.col("k"), F.col("s"), F.col("m")), rows, ["k", "s", "m"])
    assert all(abs(g - binomial(*r)) < 1e-9 for g, r in zip(got, rows, strict=True))
    for p, m in ((0.5, 3.2), (0.975, 40), (0.01, 40), (1 - 1e-7, 2), (0.3, 0.01)):
        q = values(spark, D.poisson_quantile(F.col("p"), F.col("m")), [(p, m)], ["p", "m"])[0]
        assert poisson(q, m) >= p - 1e-10 and (q == 0 or poisson(q - 1, m) < p)
        q = values(spark, D.negative_binomial_quantile(F.col("p"), F.lit(1.7), F.col("m")), [(p, m)], ["p", "m"])[0]
        assert binomial(q, 1.7, m) >= p - 1e-10 and (q == 0 or binomial(q - 1, 1.7, m) < p)
    assert values(spark, D.poisson_quantile(F.col("p"), F.col("m")), [(0.5, 0), (None, 1), (0.5, -1), (1, 1)], ["p", "m"]) == [0, None, None, None]
    assert "Python" not in spark.range(1).select(D.poisson_quantile(F.lit(0.5), F.col("id")))._jdf.queryExecution().toString()


PAYLOADS = {
    "a": {"patientName": {"dob": 1}, "items": [{"postalCode": "x"}, [{"lat": 1, "ok": "98765 43210"}]]}, "b": {"x": [{"system": "http://loinc.org", "code": "1234567890"}, {"system": "urn:x", "code": "1234567890"}]},
    "c": {"addr_line": "", "address_2": {"name": 1}, "street_no": 1, "postal": 1, "guardianPhone": 1, "status": "on 2026-01-12", "Middle Name": 1, "first-name": 1}, "d": ["a@b.co", {"deep": {"deep": {"deep": ["+91 (98765) 43210"]}}}], "e": "1234567890", "f": 7, "g": {}, "h": [],
    "i": {"name": None, "aadhaar": 1},
}


def test_identifiers_at_any_depth(spark):
    d = spark.createDataFrame([(k, json.dumps(v)) for k, v in PAYLOADS.items()] + [("n", None), ("t", "not json"), ("u", "")], "id string, payload string").withColumn("path", F.lit("clash")).withColumn("value", F.lit(1))
    got = {}
    for r in payload.violations(d, "id", "payload", ("aadhaar",)).collect():
        got.setdefault(r.id, set()).add(r.path)
    assert got == {
        "a": {"$.patientName", "$.items[0].postalCode", "$.items[1][0].lat", "$.items[1][0].ok~content"}, "b": {"$.x[1].code~content"},
        "c": {"$.addr_line", "$.address_2", "$.street_no", "$.postal", "$.guardianPhone", "$.Middle Name", "$.first-name"}, "d": {"$[0]~content", "$[1].deep.deep.deep[0]~content"}, "e": {"$~content"}, "i": {"$.name", "$.aadhaar"},
    }
    assert {r.id for r in payload.holds_key(d, "id", "payload", ("deep", "lat")).collect()} == {"a", "d"}
    assert payload.violations(d.limit(0), "id", "payload").count() == 0


def test_bundles_of_counts(spark):
    good = {"resourceType": "Bundle", "type": "collection", "entry": [{"resource": {"resourceType": "MeasureReport", "group": [{"count": 3}]}}]}
    rows = {
        "good": good, "type": good | {"type": "batch"}, "list": [1], "none": {"resourceType": "Bundle", "type": "collection"}, "patient": good | {"entry": [{"resource": {"resourceType": "Patient", "birthDate": "x"}}, {"no": 1}]},
        "link": good | {"entry": [{"resource": {"resourceType": "Observation", "a": [{"subject": {"x": 1}}]}}]},
    }
    d = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()], "id string, payload string")
    assert sorted(map(tuple, payload.bundle_errors(d, "id", "payload").collect())) == [
        ("link", "$.entry[0].resource.a[0].subject", "link to a person"), ("list", "$", "not an object"), ("none", "$.entry", "not an array"), ("patient", "$.entry[0].resource", "type of resource"),
        ("patient", "$.entry[0].resource.birthDate", "link to a person"), ("patient", "$.entry[1].resource", "not an object"), ("type", "$.type", "not collection"),
    ]


def test_catalogue(spark):
    assert metrics.catalogue(spark).count() == 26
    with pytest.raises(ValueError, match="cov_geo"):
        metrics.catalogue(spark, [("cov_geo", "coverage", "", "", "", "")])
    answers = [
        ("A", "resistance_rate", "MEM", "E. coli, Escherichia coli", "", True, "2026-01-01", 3, 10, 0, None), ("A", "resistance_rate", "MEM", "escherichia coli", None, True, "2026-02-01", 4, 8, 0, None), ("A", "resistance_rate", "MEM", "Escherichia coli", "", False, "2026-03-01", 9, 9, 0, None),
        ("B", "resistance_rate", "MEM", "Escherichia coli", "Blood", True, "2026-01-01", 1, 2, 0, None), ("B", "resistance_rate", "CIP", "", "", True, "2026-01-01", 0, 0, 0, None), ("A", "organism_distribution", "", "", "", True, "2026-01-01", 0, 0, 0, {"ECO": 4, "KPN": 3}), ("B", "organism_distribution", "", "", "", True, "2026-01-01", 0, 0, 0, {"ECO": 1, "KPN": 1}),
        ("C", "isolate_count", "", "", "", True, "2026-01-01", 0, 0, 7, None), ("Z", "isolate_count", "", "", "", True, "2026-01-01", 0, 0, 99, None),
    ]
    a = spark.createDataFrame(answers, "site string, query_type string, agent string, organism string, specimen string, ok boolean, received_at string, numerator long, denominator long, total long, buckets map<string,bigint>")
    s = spark.createDataFrame([("A", "IN/1/2", "active", "2026-01-01 11:59:00"), ("B", "IN/1/3", "active", None), ("C", "", "retired", None)], "site string, admin_path string, status string, last_seen_at string").withColumn("last_seen_at", F.col("last_seen_at").cast("timestamp"))
    got = {(r.metric, r.scope_type, r.scope_value, r.label): r for r in metrics.measured(a, s, metrics.catalogue(spark), "2026-01-01 12:00:00").collect()}
    r = got["res_eco_carbapenem", "global", "", None]
    assert (r.numerator, r.denominator, r.n_sites, r.rate_percent) == (4, 8, 1, 50.0) and r.ci_low_percent < 50 < r.ci_high_percent
    assert got["res_bsi_eco_carbapenem", "admin1", "IN/1", None].rate_percent == 50.0 and ("res_kpn_3gc", "global", "", None) not in got
    r = got["phen_mdr", "site", "B", None]
    assert (r.numerator, r.denominator, r.n_sites, r.rate_percent) == (0, 0, 0, None)
    assert got["burden_organism_mix", "global", "", "ECO"].numerator == 5 and ("burden_organism_mix", "global", "", "KPN") not in got and got["burden_isolates", "global", "", None].numerator == 7
    assert (got["cov_sites_online", "global", "", None].rate_percent, got["cov_sites_reporting", "admin0", "IN", None].rate_percent) == (50.0, 100.0)
    assert (got["cov_geo", "global", "", "admin1"].numerator, got["cov_geo", "global", "", "admin2"].numerator) == (1, 2) and got["cov_ast_completeness", "global", "", None].rate_percent is None


def test_calibration_spends_the_whole_budget(spark):
    d = spark.createDataFrame([("a", x) for x in (9.0, 8.0, 7.0, 7.0, 1.0)] + [("b", 3.0), ("b", None), ("b", float("inf")), ("b", float("nan"))], "k string, llr double")
    at = lambda budget: {r.k: (r.nulls, r.threshold) for r in evaluation.calibrated(d, budget, "k").collect()}
    assert at(2) == {"a": (5, 7.0), "b": (1, float("-inf"))} and at(0) == {"a": (5, 9.0), "b": (1, 3.0)} and at(5)["a"][1] == float("-inf")


def test_canonical_entries_are_ascii(spark):
    texts = ["plain", 'a"b\\c\n', "é ß", "\U0001f600x", "", None]
    got = spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "b string, a int").select(evaluation.canonical(["b", "a"])).collect()
    assert [r[0] for r in got] == [json.dumps({"a": k, "b": t}, sort_keys=True, separators=(",", ":")) for k, t in enumerate(texts)]


def test_broken_audit_entries(spark):
    rows, previous = [], ""
    import hashlib

    for k in range(1, 7):
        details = json.dumps({"n": k})
        digest = hashlib.sha256(details.encode()).hexdigest() if k != 2 else None
        body = {"actor": f"u{k}", "details_digest": digest} if digest else {"actor": f"u{k}", "details": details}
        own = hashlib.sha256((previous + json.dumps(body, sort_keys=True, separators=(",", ":"))).encode()).hexdigest()
        rows.append([k, f"u{k}", details, digest, None, previous, own])
        previous = own
    names = "seq int, actor string, details string, details_digest string, erased_at string, previous_hash string, hash string"
    broken = lambda: sorted(map(tuple, evaluation.broken_links(spark.createDataFrame(rows, names).withColumn("chain", F.lit(1)), ["actor"], "chain").select("seq", "reason").collect()))
    assert broken() == []
    rows[2][1], rows[3][2], rows[4][2], rows[4][4] = "forged", "{}", "", "2026-01-01"
    assert broken() == [(3, "entry"), (4, "details")]
    rows[0][6] = "0" * 64
    assert broken() == [(1, "entry"), (2, "link"), (3, "entry"), (4, "details")]


def test_identity_and_pending(spark):
    d = spark.createDataFrame([(5, " P1", "s"), (3, "p1 ", "S"), (4, None, "s"), (2, "", "s")], "isolate_id int, patient string, specimen string").withColumn("_patient", F.lit(1))
    w = spark.createDataFrame([("P1", "s "), (None, "s"), ("", "s"), ("P2", "s")], "patient string, specimen string")
    assert [r.isolate_id for r in screening.identified(d.drop("_patient"), w, ["patient", "specimen"]).orderBy(F.desc_nulls_last("isolate_id")).collect()] == [3, None, None, None]
    q = spark.createDataFrame([(1, None), (2, ["a", "z"]), (3, [])], "query_id int, targets array<string>")
    s, sent = spark.createDataFrame([("a",), ("b",)], "site string"), spark.createDataFrame([(1, "a")], "query_id int, site string")
    plan = screening.pending(q, sent, s)
    assert sorted(map(tuple, plan.collect())) == [(1, "b"), (2, "a")]


def test_rare_results(spark):
    rows = [(k, "o", "A", "S" if k else "R") for k in range(40)] + [(0, "o", "B", "R")] + [(k, "o", "C", None) for k in range(40)] + [(k, "p", "A", "R" if k else "S") for k in range(5)]
    d = spark.createDataFrame(rows, "isolate int, organism string, agent string, result string")
    got = {(r.isolate, r.agent, r.alert) for r in screening.rare_results(d, ["organism"], "isolate").collect()}
    assert got == {(0, "A", "result")}
