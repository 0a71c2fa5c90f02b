"""Queries of the scan statistics and of signals, and SQL that says what each returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resistrum.operators import benchmarking, detection, scans, signals
from resistrum.plans.analysis import query
from resistrum.sources import adapters


def e6(c: str) -> Column:
    return F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(f"{c}_e6")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day and location: values above 60 among all, by signal."""
    return adapters.events(spark, sf_dir).groupBy("signal", "location", "day").agg(F.count("*").alias("tested"), F.count_if(F.col("value") > 60).alias("cases"))


def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients by location and day; one location has none."""
    return adapters.events(spark, sf_dir).where("location <> 'L3'").groupBy("location", "day").agg(F.count_distinct("patient").cast("double").alias("population"))


#: Every window of the days with the sums of cases and tested within it, for each shape.
_WINDOWS = """
b AS (SELECT min(day) AS lo, max(day) AS hi, max(day) - min(day) + 1 AS n FROM v_event),
cells AS (SELECT signal, location, day, count(*) AS tested, count(*) FILTER (value > 60) AS cases FROM v_event GROUP BY ALL),
spans AS (SELECT lo + CAST(e - l + 1 AS INT) AS begin, lo + CAST(e AS INT) AS "end", l AS days FROM (SELECT lo, n, unnest(range(0, n)) AS e FROM b), (SELECT unnest(range(1, 61)) AS l) WHERE l <= n // 2 AND l <= e + 1)
"""
_BERNOULLI = """CASE WHEN n > 0 AND n < nn AND cc > 0 AND cc < nn AND c / n > (cc - c) / (nn - n) THEN
  CASE WHEN c > 0 THEN c * ln(c / n) ELSE 0 END + CASE WHEN n > c THEN (n - c) * ln((n - c) / n) ELSE 0 END + CASE WHEN cc > c THEN (cc - c) * ln((cc - c) / (nn - n)) ELSE 0 END
  + CASE WHEN nn - n > cc - c THEN (nn - n - cc + c) * ln((nn - n - cc + c) / (nn - n)) ELSE 0 END - cc * ln(cc / nn) - (nn - cc) * ln((nn - cc) / nn) ELSE 0 END"""


@query(f"""WITH {_WINDOWS},
shaped AS (SELECT 'space-time' AS shape, * FROM cells UNION ALL SELECT 'temporal', signal, 'All locations', day, tested, cases FROM cells),
w AS (
  SELECT shape, signal, location, begin, "end", days, sum(cases) AS observed, sum(tested) AS tested FROM shaped JOIN spans ON day BETWEEN begin AND "end" GROUP BY ALL
  UNION ALL SELECT 'spatial', signal, location, lo, hi, n, sum(cases), sum(tested) FROM cells, b GROUP BY ALL
),
t AS (SELECT signal, sum(cases)::DOUBLE AS cc, sum(tested)::DOUBLE AS nn FROM cells GROUP BY signal),
f AS (SELECT *, observed::DOUBLE AS c, tested::DOUBLE AS n FROM w JOIN t USING (signal) WHERE observed >= 3 AND tested >= 10),
l AS (SELECT *, {_BERNOULLI} AS llr FROM f)
SELECT shape, signal, location, begin, "end", days::BIGINT AS days, observed::BIGINT AS observed, tested::BIGINT AS tested, floor(llr * 1e6 + 0.5)::BIGINT AS llr_e6 FROM l WHERE llr > 1e-12""")
def bernoulli_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, out = _cells(spark, sf_dir), None
    for shape in scans.SHAPES:
        found = scans.bernoulli(cells, ["signal"], shape, prospective=False).select(F.lit(shape).alias("shape"), "signal", "location", "begin", "end", F.col("days").cast("long").alias("days"), "observed", "tested", e6("llr"))
        out = found if out is None else out.union(found)
    return out


@query(f"""WITH {_WINDOWS},
people AS (SELECT location, day, count(DISTINCT patient)::DOUBLE AS population FROM v_event WHERE location <> 'L3' GROUP BY ALL),
known AS (SELECT signal, location, day, cases FROM cells WHERE cases > 0 AND location <> 'L3'),
pairs AS (SELECT DISTINCT signal, location FROM known),
everyone AS (SELECT signal, location, day, population, coalesce(cases, 0) AS cases FROM (SELECT * FROM (SELECT DISTINCT signal FROM known), people) LEFT JOIN known USING (signal, location, day)),
shaped AS (SELECT 'space-time' AS shape, * FROM everyone SEMI JOIN pairs USING (signal, location) UNION ALL SELECT 'temporal', signal, 'All locations', day, population, cases FROM everyone),
w AS (
  SELECT shape, signal, location, begin, "end", days, sum(cases) AS observed, sum(population) AS population FROM shaped JOIN spans ON day BETWEEN begin AND "end" GROUP BY ALL
  UNION ALL SELECT 'spatial', signal, location, lo, hi, n, sum(cases), sum(population) FROM everyone SEMI JOIN pairs USING (signal, location), b GROUP BY ALL
),
t AS (SELECT signal, sum(cases)::DOUBLE AS cc FROM known GROUP BY signal),
f AS (SELECT *, observed::DOUBLE AS c, cc * population / (SELECT sum(population) FROM people) AS expected FROM w JOIN t USING (signal) WHERE observed >= 3),
l AS (SELECT *, CASE WHEN c > expected AND expected < cc THEN c * ln(c / expected) + CASE WHEN cc > c THEN (cc - c) * ln((cc - c) / (cc - expected)) ELSE 0 END ELSE 0 END AS llr FROM f WHERE expected >= 0.5)
SELECT shape, signal, location, begin, "end", days::BIGINT AS days, observed::BIGINT AS observed, floor(expected * 1e6 + 0.5)::BIGINT AS expected_e6, floor(llr * 1e6 + 0.5)::BIGINT AS llr_e6 FROM l WHERE llr > 1e-12""")
def poisson_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, population, out = _cells(spark, sf_dir), _population(spark, sf_dir), None
    for shape in scans.SHAPES:
        found = scans.poisson(cells, population, ["signal"], shape, prospective=False).select(F.lit(shape).alias("shape"), "signal", "location", "begin", "end", F.col("days").cast("long").alias("days"), "observed", e6("expected"), e6("llr"))
        out = found if out is None else out.union(found)
    return out


@query("SELECT signal, day, tested, cases FROM (SELECT signal, location, day, count(*) AS tested, count(*) FILTER (value > 60) AS cases FROM v_event GROUP BY ALL) WHERE location = 'L3'")
def population_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.orphans(_cells(spark, sf_dir), _population(spark, sf_dir)).select("signal", "day", "tested", "cases")


_SPACE_TIME = """
b AS (SELECT min(day) AS lo, max(day) AS hi, max(day) - min(day) + 1 AS n FROM v_event),
twice AS (SELECT signal, location, day FROM v_event UNION ALL SELECT 'ALL', signal, day FROM v_event),
e AS (SELECT signal, location, day, (day - lo) % 7 AS s, count(*) AS k FROM twice, b GROUP BY ALL),
spans AS (SELECT lo + CAST(e - l + 1 AS INT) AS begin, lo + CAST(e AS INT) AS "end", l AS days FROM (SELECT lo, n, unnest(range(0, n)) AS e FROM b), (SELECT unnest(range(1, 61)) AS l) WHERE l <= n // 2 AND l <= e + 1),
home AS (SELECT signal, location, s, sum(k) AS h FROM e GROUP BY ALL), tot AS (SELECT signal, s, sum(k) AS t FROM e GROUP BY ALL), dates AS (SELECT signal, s, day, sum(k) AS d FROM e GROUP BY ALL),
x AS (SELECT home.signal, home.location, dates.day, h * d / t AS mean FROM home JOIN tot USING (signal, s) JOIN dates USING (signal, s)),
w AS (SELECT x.signal, x.location, begin, "end", days, sum(mean) AS expected, sum(coalesce(k, 0)) AS observed FROM x JOIN spans ON x.day BETWEEN begin AND "end" LEFT JOIN e ON e.signal = x.signal AND e.location = x.location AND e.day = x.day GROUP BY ALL),
f AS (SELECT *, observed::DOUBLE AS o, (SELECT sum(k) FROM e WHERE e.signal = w.signal)::DOUBLE AS n FROM w WHERE observed >= 3 AND observed > expected + 1e-9),
l AS (SELECT *, CASE WHEN n > o AND n > expected THEN o * ln(o / expected) + (n - o) * ln((n - o) / (n - expected)) ELSE 0 END AS llr FROM f)
"""


@query(f"""WITH {_SPACE_TIME} SELECT signal, location, begin, "end", days::BIGINT AS days, observed::BIGINT AS observed, floor(expected * 1e6 + 0.5)::BIGINT AS expected_e6, floor(llr * 1e6 + 0.5)::BIGINT AS llr_e6 FROM l WHERE llr > 0""")
def space_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that end on any day, with the series that has signals for places."""
    found = scans.space_time(scans.with_categories(adapters.events(spark, sf_dir).select("signal", "location", "day")), prospective=False)
    return found.select("signal", "location", "begin", "end", F.col("days").cast("long").alias("days"), "observed", e6("expected"), e6("llr"))


@query(f"""WITH RECURSIVE {_SPACE_TIME}, r AS (SELECT signal, location, begin, "end", observed, floor(llr * 1e6 + 0.5)::BIGINT AS llr_e6, row_number() OVER (PARTITION BY signal, location ORDER BY floor(llr * 1e6 + 0.5) DESC, observed DESC, begin, "end") AS k FROM l WHERE llr > 0),
g AS (
  SELECT signal, location, 1::BIGINT AS k, [struct_pack(b := begin, e := "end")] AS taken, true AS took FROM r WHERE k = 1
  UNION ALL
  SELECT r.signal, r.location, r.k, CASE WHEN free THEN list_append(taken, struct_pack(b := begin, e := "end")) ELSE taken END, free
  FROM (SELECT r.*, g.taken, len(list_filter(g.taken, lambda x: x.b <= r."end" AND x.e >= r.begin)) = 0 AS free FROM g JOIN r ON r.signal = g.signal AND r.location = g.location AND r.k = g.k + 1) r
)
SELECT r.signal, r.location, r.begin, r."end", r.observed::BIGINT AS observed, r.llr_e6 FROM r JOIN g USING (signal, location, k) WHERE took""")
def chosen_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy choice of windows without common days."""
    found = space_time_windows(spark, sf_dir).select("signal", "location", "begin", "end", "observed", "llr_e6")
    return scans.non_overlapping(found, ["signal"], [-F.col("llr_e6"), -F.col("observed")])


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event an isolate of its type, with up to three agents tested."""
    e = adapters.events(spark, sf_dir)
    agents = F.array(*[F.struct(F.lit(a).alias("agent"), (F.pmod(F.col("event_id"), F.lit(m)) != 0).alias("done"), (F.col("value") > limit).alias("resistant")) for a, m, limit in (("A", 5, 60), ("B", 3, 40), ("C", 2, 80))])
    return e.select(F.col("event_id").alias("isolate_id"), F.col("signal").alias("organism"), "location", "day", "value", F.explode(agents).alias("a")).where("a.done AND value IS NOT NULL").select("isolate_id", "organism", "location", "day", "a.agent", "a.resistant")


@query(f"""WITH {_WINDOWS},
panel AS (SELECT signal AS organism, location, day, agent, value > lim AS resistant FROM v_event, (VALUES ('A', 5, 60), ('B', 3, 40), ('C', 2, 80)) AS p(agent, m, lim) WHERE event_id % m <> 0 AND value IS NOT NULL),
own AS (SELECT organism, agent, location, day, count(*) AS tested, count(*) FILTER (resistant) AS cases FROM panel GROUP BY ALL),
t AS (SELECT organism, agent, sum(cases)::DOUBLE AS cc, sum(tested)::DOUBLE AS nn FROM own GROUP BY ALL),
w AS (SELECT organism, agent, location, begin, "end", days, sum(cases) AS observed, sum(tested) AS tested FROM own JOIN spans ON day BETWEEN begin AND "end" GROUP BY ALL),
f AS (SELECT *, observed::DOUBLE AS c, tested::DOUBLE AS n FROM w JOIN t USING (organism, agent) WHERE nn >= 10),
l AS (SELECT *, {_BERNOULLI} AS llr FROM f)
SELECT organism, location, begin, "end", days::BIGINT AS days, sum(observed)::BIGINT AS observed, sum(tested)::BIGINT AS tested, count(*) AS streams, string_agg(agent, ',' ORDER BY floor(llr * 1e9) DESC, agent) AS agents, floor(sum(llr) * 1e6 + 0.5)::BIGINT AS llr_e6
FROM l WHERE llr > 1e-12 GROUP BY ALL HAVING sum(observed) >= 3""")
def multivariate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.multivariate(_panel(spark, sf_dir), prospective=False)
    return found.select("organism", "location", "begin", "end", F.col("days").cast("long").alias("days"), "observed", "tested", "streams", F.array_join("agents", ",").alias("agents"), e6("llr"))


def _reported(found: DataFrame, maxima: DataFrame, replicates: int, keys: list[str], most: int = 50) -> DataFrame:
    """The strongest windows, none overlapping another, with how often chance does as well; at most 50, a top-k report."""
    good = scans.ranked(found, maxima, replicates, report=1.0)
    return scans.non_overlapping(good, keys, [-F.col("llr"), -F.col("observed")]).orderBy(F.desc("llr"), F.desc("observed"), *keys, "location").limit(most)


@query()
def bernoulli_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    return _reported(scans.bernoulli(cells, ["signal"], prospective=False), scans.bernoulli_maxima(cells, ["signal"], prospective=False), 999, ["signal"])


@query()
def poisson_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, population = _cells(spark, sf_dir), _population(spark, sf_dir)
    return _reported(scans.poisson(cells, population, ["signal"], prospective=False), scans.poisson_maxima(cells, population, ["signal"], prospective=False), 999, ["signal"])


@query()
def multivariate_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _panel(spark, sf_dir)
    return _reported(scans.multivariate(panel, prospective=False), scans.multivariate_maxima(panel, prospective=False), 999, ["organism"])


#: Clusters of two detectors: each location's first week of a signal, and each third of the study in it.
_CLUSTERS_SQL = """
ours AS (SELECT row_number() OVER (ORDER BY signal, location) AS id, location, min(day) + CAST(count(*) % 5 AS INT) AS begin, min(day) + CAST(6 + count(*) % 7 AS INT) AS "end" FROM v_event GROUP BY signal, location),
theirs AS (SELECT row_number() OVER (ORDER BY location, signal, patient % 3) AS id, ' ' || location AS location, min(day) + CAST(count(*) % 4 AS INT) AS begin, min(day) + CAST(4 + count(*) % 9 AS INT) AS "end", (count(*) % 11)::DOUBLE AS llr FROM v_event GROUP BY location, signal, patient % 3)
"""


@query(f"""WITH RECURSIVE {_CLUSTERS_SQL},
edges AS (SELECT t.id AS t, o.id AS o, abs(t.begin - o.begin) + abs(t."end" - o."end") AS delta FROM theirs t JOIN ours o ON trim(t.location) = o.location AND t.begin <= o."end" AND o.begin <= t."end"),
r AS (SELECT id, row_number() OVER (ORDER BY llr DESC, id) AS k FROM theirs),
g AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS t, NULL::BIGINT AS o
  UNION ALL
  SELECT g.k + 1, CASE WHEN best.o IS NULL THEN used ELSE list_append(used, best.o) END, r.id, best.o FROM g JOIN r ON r.k = g.k + 1
  LEFT JOIN LATERAL (SELECT arg_min(e.o, (e.delta, e.o)) AS o FROM edges e WHERE e.t = r.id AND NOT list_contains(g.used, e.o)) best ON true
)
SELECT t AS their_id, g.o AS our_id, delta FROM g JOIN edges USING (t) WHERE g.o = edges.o""")
def matched_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.events(spark, sf_dir)
    day = lambda base, m: F.date_add(F.min("day"), (base + F.count("*") % m).cast("int"))
    ours = e.groupBy("signal", "location").agg(day(0, 5).alias("begin"), day(6, 7).alias("end"))
    theirs = e.groupBy("location", "signal", (F.col("patient") % 3).alias("part")).agg(day(0, 4).alias("begin"), day(4, 9).alias("end"), (F.count("*") % 11).cast("double").alias("llr"))
    # few enough clusters to number: as many as signals, locations and parts
    ours = ours.withColumn("id", F.row_number().over(Window.orderBy("signal", "location")).cast("long"))
    theirs = theirs.withColumn("id", F.row_number().over(Window.orderBy("location", "signal", "part")).cast("long")).withColumn("location", F.concat(F.lit(" "), "location"))
    return signals.one_to_one(theirs, ours)


#: Seeded outbreaks and signals, in other case, pooled, or over all wards.
_TRUTH_SQL = """
o AS (SELECT DISTINCT n_nationkey AS outbreak_id, lower(p_brand) AS organism, 'C' || (n_nationkey % 9) AS organism_code, CASE WHEN n_nationkey % 6 = 0 THEN 'All wards' ELSE lower(n_name) || ' ' END AS ward, DATE '1995-01-01' + CAST(n_nationkey * 11 AS INT) AS begin, DATE '1995-01-01' + CAST(n_nationkey * 11 + 5 + n_nationkey % 20 AS INT) AS "end" FROM nation JOIN part ON p_partkey = n_nationkey + 1),
s AS (SELECT o_orderkey AS signal_id, p_brand AS organism, CASE WHEN o_orderkey % 5 = 0 THEN 'All locations' ELSE n_name END AS location, o_orderdate::DATE AS begin, o_orderdate::DATE + CAST(o_orderkey % 30 AS INT) AS "end" FROM orders JOIN part ON p_partkey = o_orderkey % 200 + 1 JOIN nation ON n_nationkey = o_custkey % 25)
"""


@query(f"""WITH {_TRUTH_SQL}, c AS (SELECT s.*, outbreak_id, ward, o.begin AS b, o."end" AS e FROM s JOIN o ON (upper(trim(s.organism)) = upper(trim(o.organism)) OR upper(trim(s.organism)) = upper(trim(organism_code))) AND s.begin <= o."end" AND o.begin <= s."end")
SELECT signal_id, outbreak_id, upper(location) = upper(trim(ward)) OR (location = 'All locations' AND ward = 'All wards') AS localised, least(e, "end") - greatest(b, begin) + 1 AS overlap_days, (least(e, "end") - greatest(b, begin) + 1)::DOUBLE / (greatest(e, "end") - least(b, begin) + 1) AS jaccard
FROM c WHERE location = 'All locations' OR ward = 'All wards' OR upper(location) = upper(trim(ward))""")
def matched_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.matched(*_truth(spark, sf_dir))


@query(f"""WITH {_TRUTH_SQL} SELECT signal_id FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE (upper(trim(s.organism)) = upper(trim(o.organism)) OR upper(trim(s.organism)) = upper(trim(o.organism_code))) AND s.begin <= o."end" AND o.begin <= s."end" AND (s.location = 'All locations' OR o.ward = 'All wards' OR upper(s.location) = upper(trim(o.ward))))""")
def unmatched_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.unmatched(*_truth(spark, sf_dir)).select("signal_id")


def _truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation, part, orders = (adapters.table(spark, sf_dir, t) for t in ("nation", "part", "orders"))
    k = F.col("n_nationkey")
    at = lambda n: F.date_add(F.lit("1995-01-01").cast("date"), n.cast("int"))
    o = nation.join(part, F.col("p_partkey") == k + 1).select(
        k.alias("outbreak_id"), F.lower("p_brand").alias("organism"), F.concat(F.lit("C"), (k % 9).cast("string")).alias("organism_code"), F.when(k % 6 == 0, "All wards").otherwise(F.concat(F.lower("n_name"), F.lit(" "))).alias("ward"), at(k * 11).alias("begin"), at(k * 11 + 5 + k % 20).alias("end")
    )
    day, order = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    s = orders.join(part.select("p_partkey", "p_brand"), F.col("p_partkey") == order % 200 + 1).join(nation.select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("o_custkey") % 25)
    return s.select(order.alias("signal_id"), F.col("p_brand").alias("organism"), F.when(order % 5 == 0, "All locations").otherwise(F.col("n_name")).alias("location"), day.alias("begin"), F.date_add(day, (order % 30).cast("int")).alias("end")), o


_MECHANISMS = {"ECONOMY": "m1", "STANDARD": "m1", "SMALL": "m2", "LARGE": "m2"}


@query("""WITH m AS (SELECT * FROM (VALUES ('ECONOMY', 'm1'), ('STANDARD', 'm1'), ('SMALL', 'm2'), ('LARGE', 'm2')) AS m(agent, mechanism)), d AS (SELECT order_key, string_split(agent, ' ')[1] AS agent, result FROM v_ast WHERE result IS NOT NULL)
SELECT order_key, coalesce(mechanism, agent) AS agent, CASE max(CASE result WHEN 'R' THEN 3 WHEN 'I' THEN 2 ELSE 1 END) WHEN 3 THEN 'R' WHEN 2 THEN 'I' ELSE 'S' END AS result FROM d LEFT JOIN m USING (agent) GROUP BY ALL""")
def pooled_phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mechanisms = spark.createDataFrame(list(_MECHANISMS.items()), "agent string, mechanism string")
    return signals.pooled(adapters.ast(spark, sf_dir).select("order_key", F.split("agent", " ")[0].alias("agent"), "result"), mechanisms)


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of two models, one a cluster a year of an organism at a location, the other a later one in odd years."""
    by = adapters.ast(spark, sf_dir).where("result = 'R'").groupBy("organism", "location", F.year("specimen_date").alias("year"))
    c = by.agg(F.min("specimen_date").alias("_first"), F.count("*").alias("n"))
    id_ = lambda m: F.concat_ws("/", F.lit(m), "organism", "location", "year")
    day = lambda n: F.date_add("_first", n)
    one = c.select(id_("a").alias("signal_id"), F.lit("case-only").alias("model"), "organism", F.lit("").alias("agent"), "location", day(0).alias("begin"), day(20).alias("end"), F.col("n").cast("double").alias("llr"), (0.05 / F.col("n")).alias("p_value"), F.lit(2.0).alias("mean"), F.lit(1.5).alias("sd"))
    two = c.where("year % 2 = 1").select(id_("b").alias("signal_id"), F.lit("proportion").alias("model"), F.lower("organism").alias("organism"), F.lit(None).cast("string").alias("agent"), "location", day(20 + F.col("n").cast("int") % 2).alias("begin"), day(40).alias("end"), (F.col("n") * 2).cast("double").alias("llr"), (0.04 / F.col("n")).alias("p_value"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sd"))
    return one.union(two)


@query("""WITH c AS (SELECT organism, location, year(specimen_date) AS y, min(specimen_date) AS f, count(*) AS n FROM v_ast WHERE result = 'R' GROUP BY ALL),
s AS (
  SELECT 'a/' || organism || '/' || location || '/' || y AS signal_id, 'case-only' AS model, organism, location, f AS begin, f + 20 AS "end", round((n - 2.0::DOUBLE) / 1.5, 3) AS evidence, 0.05::DOUBLE / n AS p, n::DOUBLE AS llr FROM c
  UNION ALL SELECT 'b/' || organism || '/' || location || '/' || y, 'proportion', lower(organism), location, f + 20 + CAST(n % 2 AS INT), f + 40, round(2.0::DOUBLE * n, 3), 0.04::DOUBLE / n, 2.0::DOUBLE * n FROM c WHERE y % 2 = 1
),
j AS (SELECT b.signal_id, arg_min(a.signal_id, (-a.llr, a.signal_id)) AS grp FROM s b JOIN s a ON a.model = 'case-only' AND b.model = 'proportion' AND upper(a.organism) = upper(b.organism) AND a.location = b.location AND a.begin <= b."end" AND b.begin <= a."end" GROUP BY 1),
g AS (SELECT s.*, coalesce(grp, signal_id) AS grp FROM s LEFT JOIN j USING (signal_id)),
m AS (SELECT arg_min(signal_id, (p, -evidence, signal_id)) AS signal_id, arg_min(organism, (p, -evidence, signal_id)) AS organism, arg_min(location, (p, -evidence, signal_id)) AS location, arg_min(begin, (p, -evidence, signal_id)) AS begin, arg_min("end", (p, -evidence, signal_id)) AS "end", round(1 - pow(1 - min(p), 2), 4) AS p_value, max(evidence) AS evidence, count(*) AS n_models FROM g GROUP BY grp),
i AS (SELECT upper(organism) AS organism, location, specimen_date AS d, CASE WHEN admission_date <= specimen_date THEN admission_date ELSE specimen_date - 14 END AS a, CASE WHEN admission_date <= specimen_date THEN specimen_date ELSE specimen_date + 14 END AS e FROM v_isolate),
k AS (SELECT signal_id, a, e, row_number() OVER (PARTITION BY signal_id ORDER BY a, e) AS r FROM m JOIN i ON upper(m.organism) = i.organism AND m.location = i.location AND d BETWEEN begin AND "end"),
pl AS (SELECT x.signal_id, count(*) AS n_cases, count(*) FILTER (EXISTS (SELECT 1 FROM k y WHERE y.signal_id = x.signal_id AND y.r <> x.r AND y.a <= x.e AND x.a <= y.e)) AS good FROM k x GROUP BY 1),
o AS (SELECT signal_id, p_value, evidence, n_models, coalesce(n_cases, 0) AS n_cases, CASE WHEN n_cases >= 2 THEN round(good::DOUBLE / n_cases, 4) ELSE 0 END AS plausibility, CASE WHEN p_value <= 0.004 THEN 'alert' ELSE 'monitor' END AS status FROM m LEFT JOIN pl USING (signal_id))
SELECT signal_id, status, n_models, n_cases, floor(p_value * 1e4 + 0.5)::BIGINT AS p_e4, floor(evidence * 1e3 + 0.5)::BIGINT AS evidence_e3, floor(plausibility * 1e4 + 0.5)::BIGINT AS plausibility_e4, row_number() OVER (ORDER BY CASE status WHEN 'alert' THEN 0 ELSE 1 END, floor(evidence + 0.5) DESC, plausibility DESC, evidence DESC, p_value, signal_id) AS rank FROM o""")
def ranked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' signals as clusters, in the order in which they are read."""
    cases = adapters.isolates(spark, sf_dir).withColumn("agent", F.lit(None).cast("string"))
    found = signals.evaluated(_streams(spark, sf_dir), cases, 2, 0.004, 1.0, 999)
    # a rank of all clusters, as many as organisms, locations and years
    rank = F.row_number().over(Window.orderBy(*signals.banded_order())).cast("long")
    fixed = lambda c, n: F.floor(F.col(c) * 10**n + 0.5).cast("long").alias(f"{c.removesuffix('_value')}_e{n}")
    return found.select("signal_id", "status", "n_models", "n_cases", fixed("p_value", 4), fixed("evidence", 3), fixed("plausibility", 4), rank.alias("rank"))


@query()
def phenotype_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams pooled by mechanism, scanned for cases and for proportions, merged and ordered: at most 50, a top-k report."""
    e = adapters.events(spark, sf_dir)
    panel = _panel(spark, sf_dir).withColumn("result", F.when(F.col("resistant"), "R").otherwise("S")).drop("resistant")
    mapped = signals.pooled(panel, spark.createDataFrame([("A", "mechanism-1"), ("B", "mechanism-1")], "agent string, mechanism string"))
    stream = F.concat_ws("\t", "organism", "agent")
    resistant = mapped.where("result = 'R'")
    events = resistant.select(stream.alias("signal"), "location", "day")
    found = scans.space_time(events).join(events.groupBy("signal").agg(F.count_distinct("location").alias("_n")).where("_n > 1").select("signal"), "signal", "left_semi")
    nulls = detection.null_maxima(events, 999, 60)
    cells = mapped.withColumn("signal", stream).groupBy("signal", "location", "day").agg(F.count("*").alias("tested"), F.count_if(F.col("result") == "R").alias("cases"))
    proportion_nulls = scans.bernoulli_maxima(cells, ["signal"])
    every = None
    for model, windows, maxima in (("case-only", found, nulls), ("proportion", scans.bernoulli(cells, ["signal"]), proportion_nulls)):
        chosen = scans.non_overlapping(scans.ranked(windows, maxima, 999, report=1.0), ["signal"], [-F.col("llr"), -F.col("observed")])
        moments = maxima.agg(F.avg("top").alias("mean"), F.stddev_pop("top").alias("sd"))
        parts = F.split("signal", "\t")
        rows = chosen.join(F.broadcast(moments)).select(F.concat_ws("/", F.lit(model), "signal", "location", "begin").alias("signal_id"), F.lit(model).alias("model"), parts[0].alias("organism"), parts[1].alias("agent"), "location", "begin", "end", "llr", "p_value", "mean", "sd")
        every = rows if every is None else every.union(rows)
    cases = resistant.select("organism", "agent", "location", F.col("day").alias("specimen_date"), F.lit(None).cast("date").alias("admission_date"))
    span = e.agg((F.datediff(F.max("day"), F.min("day")) + 1).alias("n")).first().n or 0
    return signals.evaluated(every, cases, 2, 1.0, span / 365.25, 999).orderBy(*signals.banded_order()).limit(50)


@query(f"""WITH {_TRUTH_SQL}, sc AS (SELECT *, signal_id % 4 AS cell FROM s), oc AS (SELECT *, cell FROM o, (SELECT unnest(range(4)) AS cell)),
m AS (SELECT sc.cell, signal_id, outbreak_id, upper(sc.location) = upper(trim(ward)) OR (sc.location = 'All locations' AND ward = 'All wards') AS localised, (least(oc."end", sc."end") - greatest(oc.begin, sc.begin) + 1)::DOUBLE / (greatest(oc."end", sc."end") - least(oc.begin, sc.begin) + 1) AS jaccard
  FROM sc JOIN oc ON sc.cell = oc.cell AND (upper(trim(sc.organism)) = upper(trim(oc.organism)) OR upper(trim(sc.organism)) = upper(trim(organism_code))) AND sc.begin <= oc."end" AND oc.begin <= sc."end" WHERE sc.location = 'All locations' OR ward = 'All wards' OR upper(sc.location) = upper(trim(ward))),
a AS (SELECT (SELECT count(*) FROM oc) AS presented, (SELECT count(*) FROM (SELECT DISTINCT cell, outbreak_id FROM m)) AS detected, (SELECT count(*) FROM sc) AS alerted, (SELECT count(*) FROM (SELECT DISTINCT cell, signal_id FROM m)) AS matched, count(*) FILTER (localised) AS localised, count(*) AS matches, median(jaccard) AS temporal FROM m)
SELECT presented, detected, alerted, alerted - matched AS false_alerts, floor(detected / presented * 1e6 + 0.5)::BIGINT AS sensitivity_e6, floor(matched / alerted * 1e6 + 0.5)::BIGINT AS predictive_value_e6, floor(localised / matches * 1e6 + 0.5)::BIGINT AS spatial_accuracy_e6, floor(temporal * 1e6 + 0.5)::BIGINT AS temporal_accuracy_e6 FROM a""")
def detector_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What signals are worth against seeded outbreaks that stand in each of four cells."""
    found, truth = _truth(spark, sf_dir)
    cells = truth.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    rows = benchmarking.outcomes(found.withColumn("cell", (F.col("signal_id") % 4).cast("long")), cells, "cell")
    out = benchmarking.endpoints(rows)
    return out.select("presented", "detected", "alerted", "false_alerts", *[e6(c) for c in ("sensitivity", "predictive_value", "spatial_accuracy", "temporal_accuracy")])


@query()
def detection_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How soon a scan of proportions, run every second day, would have found each location's days of most cases."""
    cells = _cells(spark, sf_dir)
    worst = cells.groupBy("signal", "location").agg(F.max_by("day", F.struct("cases", "day")).alias("begin"))
    outbreaks = worst.select(F.concat_ws("/", "signal", "location").alias("outbreak_id"), F.col("signal").alias("organism"), F.col("signal").alias("organism_code"), F.col("location").alias("ward"), "begin", F.date_add("begin", 9).alias("end"))
    return benchmarking.delays(benchmarking.bernoulli_at_cuts(cells, "signal", least_tested=3), outbreaks, threshold=0.5, stride=2)
