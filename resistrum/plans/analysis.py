"""Queries of the surveillance operators over the adapter tables, and SQL that says what each returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resistrum.functions import clinical, stats
from resistrum.operators import cohort, detection, federated, rules, susceptibility
from resistrum.sources import adapters
from resistrum.sources.adapters import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
AGENTS = ["ECONOMY", "STANDARD", "SMALL", "MEDIUM", "LARGE", "PROMO"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


RATES = "count(result) AS tested, count(*) FILTER (result = 'R') AS r, count(*) FILTER (result = 'I') AS i, count(*) FILTER (result = 'S') AS s"
PCTS = ", ".join(f"CASE WHEN tested > 0 THEN 100.0::DOUBLE * {x} / tested END AS pct_{x}" for x in "ris")


def rates_sql(keys: str) -> str:
    return f"SELECT *, {PCTS} FROM (SELECT {keys}, {RATES} FROM v_ast GROUP BY {keys})"


@query(rates_sql("location, agent"))
def antibiogram_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return susceptibility.rates(adapters.ast(spark, sf_dir), "location", "agent")


@query(rates_sql("agent"))
def antibiogram_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return susceptibility.rates(adapters.ast(spark, sf_dir), "agent")


@query(rates_sql("site, organism, specimen, year(specimen_date) AS year, agent").replace("GROUP BY site, organism, specimen, year(specimen_date) AS year, agent", "GROUP BY ALL"))
def live_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return susceptibility.rates(adapters.ast(spark, sf_dir).withColumn("year", F.year("specimen_date").cast("long")), "site", "organism", "specimen", "year", "agent")


@query(f"SELECT *, {PCTS} FROM (SELECT strftime(specimen_date, '%Y-%m') AS month, agent, {RATES} FROM v_ast GROUP BY 1, 2)")
def monthly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return susceptibility.rates(adapters.ast(spark, sf_dir).withColumn("month", F.date_format("specimen_date", "yyyy-MM")), "month", "agent")


@query(f"SELECT agent, tested, r, i, s, mean, least, median, most, CASE WHEN tested > 0 THEN 100.0::DOUBLE * r / tested END AS pct_r FROM (SELECT agent, {RATES}, avg(measurement) AS mean, min(measurement) AS least, median(measurement) AS median, max(measurement) AS most FROM v_ast GROUP BY agent)")
def agent_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return susceptibility.measured_rates(adapters.ast(spark, sf_dir))


@query("SELECT organism, " + ", ".join(f"CASE WHEN count(result) FILTER (agent = '{a}') >= 30 THEN 100.0::DOUBLE - 100.0::DOUBLE * count(*) FILTER (agent = '{a}' AND result = 'R') / count(result) FILTER (agent = '{a}') END AS s_{k}" for k, a in enumerate(AGENTS)) + " FROM v_ast GROUP BY organism")
def antibiogram_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return susceptibility.grid(adapters.ast(spark, sf_dir), AGENTS)


@query("""SELECT 'organism' AS kind, organism AS label, count(*) AS n FROM v_isolate GROUP BY organism UNION ALL SELECT 'specimen', specimen, count(*) FROM v_isolate GROUP BY specimen
UNION ALL SELECT 'month', strftime(specimen_date, '%Y-%m'), count(*) FROM v_isolate GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*) FROM v_isolate""")
def isolate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return susceptibility.totals(adapters.isolates(spark, sf_dir))


@query("SELECT count(*) AS n, count(DISTINCT patient) AS n_patient, count(DISTINCT organism) AS n_organism, count(DISTINCT specimen) AS n_specimen, count(DISTINCT site) AS n_site, count(DISTINCT location) AS n_location, min(specimen_date) AS first_date, max(specimen_date) AS last_date FROM v_isolate")
def isolate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return susceptibility.summary(adapters.isolates(spark, sf_dir))


@query("SELECT count(*) AS n, count(*) FILTER (patient IS NULL) AS no_patient, count(*) FILTER (organism IS NULL) AS no_organism, count(*) FILTER (specimen_date < admission_date) AS before_admission, median(CASE WHEN specimen_date >= admission_date THEN date_diff('day', admission_date, specimen_date) END)::DOUBLE AS median_lag FROM v_isolate")
def isolate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return susceptibility.quality(adapters.isolates(spark, sf_dir))


def _indicators() -> tuple[susceptibility.Indicator, ...]:
    return (susceptibility.Indicator("group 1", ("brand#1",), ("ECONOMY", "STANDARD")), susceptibility.Indicator("group 2", ("brand#2", "brand#3"), ("SMALL",), ("R",)))


@query("""WITH m AS (SELECT 'group 1' AS label, order_key, organism, bool_or(result IN ('R', 'I')) AS hit FROM v_ast WHERE contains(lower(organism), 'brand#1') AND agent IN ('ECONOMY', 'STANDARD') AND result IS NOT NULL GROUP BY 1, 2, 3
UNION ALL SELECT 'group 2', order_key, organism, bool_or(result = 'R') FROM v_ast WHERE (contains(lower(organism), 'brand#2') OR contains(lower(organism), 'brand#3')) AND agent = 'SMALL' AND result IS NOT NULL GROUP BY 1, 2, 3)
SELECT label, count(*) AS denominator, count(*) FILTER (hit) AS numerator, 100.0::DOUBLE * count(*) FILTER (hit) / count(*) AS pct FROM m GROUP BY label""")
def priority_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.ast(spark, sf_dir).withColumn("isolate_id", F.struct("order_key", "organism"))
    return susceptibility.indicators(rows, _indicators())


@query("""WITH d AS (SELECT specimen_date AS day, location, organism, agent, order_key, result FROM v_ast WHERE result IS NOT NULL)
SELECT day, location, organism, agent, count(*) AS tested, count(*) FILTER (result = 'R') AS resistant FROM d GROUP BY 1, 2, 3, 4
UNION ALL SELECT day, location, organism, '', count(*), count(*) FILTER (hit) FROM (SELECT day, location, organism, order_key, bool_or(result = 'R') AS hit FROM d GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
def denominator_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return susceptibility.denominators(adapters.ast(spark, sf_dir).withColumn("isolate_id", F.col("order_key")))


@query("""WITH o AS (SELECT *, CASE WHEN location_type = 'out' THEN 'Community' WHEN date_diff('day', admission_date, specimen_date) > 2 THEN 'Hospital' ELSE 'Community' END AS origin FROM v_ast)
SELECT origin, agent, count(*) FILTER (result = 'R') AS numerator, count(result) AS denominator FROM o GROUP BY 1, 2""")
def payload_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = clinical.infection_origin(F.col("location_type"), F.col("admission_date"), F.col("specimen_date"))
    return adapters.ast(spark, sf_dir).groupBy(origin.alias("origin"), "agent").agg(F.count_if(F.col("result") == "R").alias("numerator"), F.count("result").alias("denominator"))


@query("""SELECT site, patient, organism, isolate_id FROM (SELECT *, row_number() OVER (PARTITION BY site, patient, organism ORDER BY specimen_date NULLS LAST, isolate_id) AS k FROM v_isolate) WHERE k = 1""")
def first_isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.first_isolates(adapters.isolates(spark, sf_dir)).select("site", "patient", "organism", "isolate_id")


EPISODES = """WITH RECURSIVE d AS (SELECT patient, signal, day, min(event_id) AS event_id FROM v_event GROUP BY 1, 2, 3),
k AS (SELECT patient, signal, day, row_number() OVER (PARTITION BY patient, signal ORDER BY day) AS n FROM d),
w AS (SELECT patient, signal, n, day, day AS last_day, true AS kept FROM k WHERE n = 1
UNION ALL SELECT k.patient, k.signal, k.n, k.day, CASE WHEN k.day - w.last_day > 7 THEN k.day ELSE w.last_day END, k.day - w.last_day > 7 FROM w JOIN k ON k.patient = w.patient AND k.signal = w.signal AND k.n = w.n + 1),
e AS (SELECT d.patient, d.signal, d.day, d.event_id FROM w JOIN d USING (patient, signal, day) WHERE kept) """


@query(EPISODES + "SELECT * FROM e")
def episode_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.episodes(adapters.events(spark, sf_dir), 7)


@query(EPISODES + "SELECT day, signal, count(*) AS n FROM e GROUP BY 1, 2")
def wire_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.episodes(adapters.events(spark, sf_dir), 7).groupBy("day", "signal").agg(F.count("*").alias("n"))


@query("SELECT isolate_id, organism, duplicate_of FROM (SELECT *, min(isolate_id) OVER (PARTITION BY site, patient, organism, specimen, specimen_date) AS duplicate_of FROM v_isolate) WHERE duplicate_of <> isolate_id")
def duplicate_isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.duplicates(adapters.isolates(spark, sf_dir)).select("isolate_id", "organism", "duplicate_of")


@query("""SELECT a.isolate_id, a.organism, (a.specimen_date - max(b.specimen_date))::INT AS days_since, max(b.specimen_date) IS NOT NULL AS is_repeat
FROM v_isolate a LEFT JOIN v_isolate b ON a.site = b.site AND a.patient = b.patient AND a.organism = b.organism AND b.specimen_date < a.specimen_date GROUP BY a.isolate_id, a.organism, a.specimen_date""")
def repeat_isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.repeats(adapters.isolates(spark, sf_dir)).select("isolate_id", "organism", "days_since", "is_repeat")


STAYS = "SELECT l_orderkey * 10 + l_linenumber AS stay_id, location, least(admission_date, specimen_date) AS begin, least(admission_date, specimen_date) + 2 AS \"end\" FROM (SELECT order_key AS l_orderkey, line AS l_linenumber, min(location) AS location, min(admission_date) AS admission_date, min(specimen_date) AS specimen_date FROM v_ast GROUP BY 1, 2)"


def _stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = adapters.ast(spark, sf_dir).groupBy("order_key", "line").agg(F.min("location").alias("location"), F.min("admission_date").alias("a"), F.min("specimen_date").alias("s"))
    begin = F.least("a", "s")
    return one.select((F.col("order_key") * 10 + F.col("line")).alias("stay_id"), "location", begin.alias("begin"), F.date_add(begin, 2).alias("end"))


@query(f"""WITH t AS ({STAYS}), w AS (SELECT *, max("end") OVER (PARTITION BY location ORDER BY begin, "end", stay_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= begin AS a, lead(begin) OVER (PARTITION BY location ORDER BY begin, "end", stay_id) <= "end" AS b FROM t)
SELECT location, count(*) AS stays, count(*) FILTER (coalesce(a, false) OR coalesce(b, false)) AS overlapping FROM w GROUP BY location""")
def transmission_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.overlapping_stays(_stays(spark, sf_dir)).groupBy("location").agg(F.count("*").alias("stays"), F.count_if("overlaps").alias("overlapping"))


@query("""WITH i AS (SELECT DISTINCT organism, location, specimen_date AS b, specimen_date + 3 AS e FROM v_isolate), o AS (SELECT *, max(e) OVER (PARTITION BY organism, location ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
r AS (SELECT *, sum(CASE WHEN b <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY organism, location ORDER BY b, e) AS run FROM o)
SELECT organism, location, min(b) AS begin, max(e) AS "end", count(*) AS merged FROM r GROUP BY organism, location, run""")
def cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = adapters.isolates(spark, sf_dir).select("organism", "location", F.col("specimen_date").alias("begin"), F.date_add("specimen_date", 3).alias("end")).distinct()
    return cohort.merged_intervals(i)


@query("SELECT site, agent, max(period) AS period, arg_max(numerator, period) AS numerator, arg_max(denominator, period) AS denominator FROM v_result GROUP BY site, agent")
def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federated.latest(adapters.results(spark, sf_dir), ["site", "agent"], ["period"]).select("site", "agent", "period", "numerator", "denominator")


WILSON = "numerator, denominator, n_sites, 100.0::DOUBLE * numerator / denominator AS rate, 100 * greatest(0, (p + zz / (2 * n) - z * sqrt((p * (1 - p) + zz / (4 * n)) / n)) / (1 + zz / n)) AS low, 100 * least(1, (p + zz / (2 * n) + z * sqrt((p * (1 - p) + zz / (4 * n)) / n)) / (1 + zz / n)) AS high"
Z = "1.959963984540054::DOUBLE AS z, (1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE) AS zz, numerator::DOUBLE / denominator AS p, denominator::DOUBLE AS n"


@query(f"SELECT agent, {WILSON} FROM (SELECT *, {Z} FROM (SELECT agent, sum(numerator)::BIGINT AS numerator, sum(denominator)::BIGINT AS denominator, count(DISTINCT site) AS n_sites FROM v_result GROUP BY agent))")
def cross_site_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federated.rolled_up(adapters.results(spark, sf_dir), "agent")


@query(f"""WITH u AS (SELECT 'W' AS unit, * FROM v_result UNION ALL SELECT split_part(admin_path, '/', 1) || '/' || split_part(admin_path, '/', 2), * FROM v_result UNION ALL SELECT admin_path, * FROM v_result)
SELECT unit, agent, {WILSON} FROM (SELECT *, {Z} FROM (SELECT unit, agent, sum(numerator)::BIGINT AS numerator, sum(denominator)::BIGINT AS denominator, count(DISTINCT site) AS n_sites FROM u GROUP BY unit, agent))""")
def rates_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federated.rolled_up(federated.by_prefix(adapters.results(spark, sf_dir)), "unit", "agent")


@query("SELECT organism, location, count(*) AS n FROM v_isolate GROUP BY 1, 2 HAVING count(*) >= 20")
def suppressed_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federated.suppressed(adapters.isolates(spark, sf_dir).groupBy("organism", "location").agg(F.count("*").alias("n")), "n", 20)


@query("""SELECT count(DISTINCT site) AS n_sites, count(DISTINCT CASE WHEN received_at >= DATE '1997-01-01' THEN site END) AS reporting, count(DISTINCT split_part(admin_path, '/', 2)) AS level_1, count(DISTINCT admin_path) AS level_2 FROM v_result""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federated.coverage(adapters.results(spark, sf_dir), "1997-01-01")


@query("""SELECT agent, period, numerator, denominator, row_number() OVER (PARTITION BY agent ORDER BY period) AS place FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY period DESC) AS k FROM (SELECT agent, period, sum(numerator)::BIGINT AS numerator, sum(denominator)::BIGINT AS denominator FROM v_result GROUP BY 1, 2)) WHERE k <= 12""")
def trend_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.results(spark, sf_dir).groupBy("agent", "period").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    return federated.last_points(s, ["agent"], "period")


SNAPS = "a AS (SELECT site, agent, arg_max(numerator, period) AS v FROM v_result WHERE period < DATE '1997-01-01' GROUP BY 1, 2), b AS (SELECT site, agent, arg_max(numerator, period) AS v FROM v_result WHERE period >= DATE '1995-01-01' GROUP BY 1, 2)"


@query(f"""WITH {SNAPS} SELECT site, agent, a.v AS before, b.v AS after, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM a FULL JOIN b USING (site, agent) WHERE a.v IS DISTINCT FROM b.v""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapters.results(spark, sf_dir)
    newest = lambda d: federated.latest(d, ["site", "agent"], ["period"])
    return federated.changed(newest(r.where("period < DATE '1997-01-01'")), newest(r.where("period >= DATE '1995-01-01'")), ["site", "agent"], "numerator")


@query("""WITH u AS (SELECT admin_path AS unit, agent, 100.0::DOUBLE * sum(numerator) / sum(denominator) AS rate FROM v_result GROUP BY 1, 2), n AS (SELECT agent, 100.0::DOUBLE * sum(numerator) / sum(denominator) AS national FROM v_result GROUP BY 1)
SELECT unit, agent, rate, national, rate - national AS delta, CASE WHEN rate >= 50 THEN 'critical' WHEN rate >= 25 THEN 'high' WHEN rate >= 10 THEN 'moderate' ELSE 'low' END AS band FROM u JOIN n USING (agent)""")
def benchmark_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapters.results(spark, sf_dir)
    rate = (F.lit(100.0) * F.sum("numerator") / F.sum("denominator")).alias("rate")
    return federated.benchmark(r.groupBy(F.col("admin_path").alias("unit"), "agent").agg(rate), r.groupBy("agent").agg(rate))


@query("SELECT site, agent, count(*) AS n FROM v_result WHERE admin_path = 'W/1' OR starts_with(admin_path, 'W/1/') GROUP BY 1, 2")
def scoped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.results(spark, sf_dir).where(federated.scope("state", "W/1")).groupBy("site", "agent").agg(F.count("*").alias("n"))


def _breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("organism"), F.col("p_type").alias("agent")).agg(F.min("p_size").alias("a"), F.max("p_size").alias("b"))
    wide = p.select("organism", "agent", F.lit(None).cast("string").alias("specimen"), F.lit(None).cast("string").alias("location_type"), F.col("a").cast("double").alias("s"), F.col("b").cast("double").alias("r"))
    urgent = p.select("organism", "agent", F.lit("1-URGENT"), F.lit(None).cast("string"), (F.col("a") + 5).cast("double"), F.col("b").cast("double"))
    torn = p.where("organism LIKE '%1'").select("organism", "agent", F.lit("1-URGENT"), F.lit(None).cast("string"), (F.col("a") + 6).cast("double"), F.col("b").cast("double"))
    return wide.union(urgent).union(torn)


@query("""WITH p AS (SELECT p_brand AS organism, p_type AS agent, min(p_size) AS a, max(p_size) AS b FROM part GROUP BY 1, 2),
r AS (SELECT v.*, CASE WHEN specimen <> '1-URGENT' THEN a WHEN organism LIKE '%1' THEN NULL ELSE a + 5 END::DOUBLE AS sb, CASE WHEN specimen = '1-URGENT' AND organism LIKE '%1' THEN NULL ELSE b END::DOUBLE AS rb FROM v_ast v JOIN p USING (organism, agent))
SELECT organism, agent, specimen, CASE WHEN measurement <= sb THEN 'S' WHEN measurement > rb THEN 'R' WHEN sb IS NOT NULL AND rb IS NOT NULL THEN 'I' END AS reading, count(*) AS n FROM r GROUP BY ALL""")
def breakpoint_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["order_key", "line", "part_key", "site", "specimen_date"]
    rows = adapters.ast(spark, sf_dir).select(*key, "organism", "agent", "specimen", "location_type", "measurement")
    return rules.with_breakpoints(rows, _breakpoints(spark, sf_dir), key).groupBy("organism", "agent", "specimen", "reading").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN agent = 'SMALL' THEN 'alert a' ELSE 'alert b' END AS label, organism, count(*) AS n FROM v_ast WHERE (organism = 'Brand#11' AND agent = 'SMALL' AND result = 'R') OR (organism = 'Brand#22' AND agent = 'PROMO' AND result IN ('R', 'I')) GROUP BY 1, 2")
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([("Brand#11", "SMALL", ["R"], "alert a"), ("Brand#22", "PROMO", ["R", "I"], "alert b")], "organism string, agent string, results array<string>, label string")
    return rules.alerts(adapters.ast(spark, sf_dir), table).groupBy("label", "organism").agg(F.count("*").alias("n"))


@query("SELECT organism, agent, specimen, count(*) AS n FROM v_ast WHERE result = 'S' AND organism = 'Brand#12' AND agent = 'LARGE' AND specimen <> '5-LOW' GROUP BY ALL")
def unexpected_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([("Brand#12", "LARGE", ["5-LOW"])], "organism string, agent string, except_specimens array<string>")
    return rules.unexpected(adapters.ast(spark, sf_dir), table).groupBy("organism", "agent", "specimen").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT order_key, max(result) FILTER (agent = 'SMALL') AS a, max(result) FILTER (agent = 'PROMO') AS b, max(result) FILTER (agent = 'LARGE') AS c FROM v_ast GROUP BY order_key)
SELECT order_key FROM m WHERE coalesce(a = 'R' AND b IN ('R', 'I'), false) OR coalesce(c = 'S', false)""")
def rule_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = adapters.ast(spark, sf_dir).where("result IS NOT NULL").groupBy("order_key", "agent").agg(F.max("result").alias("result"))
    rows = one.groupBy("order_key").agg(F.map_from_entries(F.collect_list(F.struct("agent", "result"))).alias("results"))
    return rows.where(rules.criteria("SMALL=R AND PROMO=NS OR LARGE=S")).select("order_key")


@query("""WITH k AS (SELECT substr(n_name, 1, 3) AS prefix, min(n_nationkey) AS place FROM nation GROUP BY 1 UNION ALL SELECT n_name, n_nationkey FROM nation),
c AS (SELECT DISTINCT n_name || '-' || s_suppkey AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT code, arg_max(prefix, length(prefix)) AS prefix, arg_max(place, length(prefix)) AS place FROM c JOIN k ON starts_with(code, prefix) GROUP BY code""")
def longest_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapters.table(spark, sf_dir, "nation")
    known = n.groupBy(F.substring("n_name", 1, 3).alias("prefix")).agg(F.min("n_nationkey").alias("place")).union(n.select("n_name", "n_nationkey"))
    s = adapters.table(spark, sf_dir, "supplier")
    codes = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.concat_ws("-", "n_name", "s_suppkey").alias("code")).distinct()
    return rules.longest_prefix(codes, known)


@query("SELECT target, count(DISTINCT source) AS n, CASE WHEN count(DISTINCT source) = 1 THEN min(source) END AS source FROM (SELECT p_brand AS source, p_size AS target FROM part) GROUP BY target")
def inverse_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.inverse_map(adapters.table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.col("p_size").alias("target")))


DAILY = """b AS (SELECT min(day) AS lo, max(day) AS hi FROM v_event), c AS (SELECT location, signal, day, count(*) AS cases FROM v_event GROUP BY ALL UNION ALL SELECT 'All locations', signal, day, count(*) FROM v_event GROUP BY 2, 3),
days AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM b), k AS (SELECT DISTINCT location, signal FROM c),
s AS (SELECT location, signal, day, coalesce(cases, 0)::BIGINT AS cases FROM k CROSS JOIN days LEFT JOIN c USING (location, signal, day))"""


@query(f"WITH {DAILY} SELECT * FROM s")
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.daily(adapters.events(spark, sf_dir))


@query(f"""WITH {DAILY}, p AS (SELECT location, signal, cases, day, ((SELECT hi FROM b) - day) // 7 AS back FROM s)
SELECT location, signal, max(day) AS period_end, sum(cases)::BIGINT AS cases FROM p GROUP BY location, signal, back HAVING count(*) = 7""")
def weekly_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.periods(detection.daily(adapters.events(spark, sf_dir)))


CUSUM = f"{DAILY}, t AS (SELECT *, sum(cases - 8.5::DOUBLE) OVER (PARTITION BY location, signal ORDER BY day) AS p FROM s), q AS (SELECT location, signal, day, cases, p - least(0, min(p) OVER (PARTITION BY location, signal ORDER BY day)) AS cusum FROM t)"


@query(f"WITH {CUSUM} SELECT * FROM q")
def cusum_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.cusum(detection.daily(adapters.events(spark, sf_dir)), 8.0, 0.5)


@query(f"""WITH {CUSUM}, o AS (SELECT *, cusum > 4 AND NOT coalesce(lag(cusum > 4) OVER (PARTITION BY location, signal ORDER BY day), false) AS opened FROM q),
r AS (SELECT *, sum(opened::INT) OVER (PARTITION BY location, signal ORDER BY day) AS run FROM o)
SELECT location, signal, min(day) AS begin, max(day) AS "end", count(*) AS days, max(cusum) AS peak FROM r WHERE cusum > 4 GROUP BY location, signal, run""")
def cusum_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.runs(detection.cusum(detection.daily(adapters.events(spark, sf_dir)), 8.0, 0.5), "cusum", 4.0)


@query(f"""WITH RECURSIVE {DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY location, signal ORDER BY day) AS k FROM s),
w AS (SELECT location, signal, k, day, cases, cases::DOUBLE AS ewma FROM n WHERE k = 1 UNION ALL SELECT n.location, n.signal, n.k, n.day, n.cases, 0.25::DOUBLE * n.cases + 0.75::DOUBLE * w.ewma FROM w JOIN n ON n.location = w.location AND n.signal = w.signal AND n.k = w.k + 1)
SELECT location, signal, day, cases, ewma FROM w""")
def ewma_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.ewma(detection.daily(adapters.events(spark, sf_dir)), 0.25)


@query(f"WITH {DAILY} SELECT *, (sum(cases) OVER w)::BIGINT AS recent, sum(cases) OVER w >= 5 AS enough FROM s WINDOW w AS (PARTITION BY location, signal ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def recent_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.recent_guard(detection.daily(adapters.events(spark, sf_dir)))


@query("""WITH b AS (SELECT min(day) AS lo, max(day) AS hi FROM v_event), e AS (SELECT signal, location, (day - lo) % 7 AS s, hi - day + 1 AS age FROM v_event, b),
d AS (SELECT unnest(range(1, 15)) AS days), loc AS (SELECT signal, location, s, count(*) AS n FROM e GROUP BY ALL), tot AS (SELECT signal, s, count(*) AS n FROM e GROUP BY ALL),
win AS (SELECT signal, s, days, count(*) AS n FROM e JOIN d ON age <= days GROUP BY ALL),
x AS (SELECT loc.signal, loc.location, win.days, sum(loc.n * win.n / tot.n) AS expected FROM loc JOIN tot USING (signal, s) JOIN win USING (signal, s) GROUP BY ALL),
o AS (SELECT signal, location, days, count(*) AS observed FROM e JOIN d ON age <= days GROUP BY ALL HAVING count(*) >= 3), t AS (SELECT signal, count(*) AS total FROM e GROUP BY ALL),
f AS (SELECT *, observed::DOUBLE AS o, total::DOUBLE AS n FROM o JOIN x USING (signal, location, days) JOIN t USING (signal))
SELECT signal, location, days, observed, total, floor(expected * 1e6 + 0.5)::BIGINT AS expected_e6, floor(1e6 * CASE WHEN o > expected + 1e-9 AND n > o THEN o * ln(o / expected) + (n - o) * ln((n - o) / (n - expected)) ELSE 0 END + 0.5)::BIGINT AS llr_e6 FROM f""")
def scan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detection.prospective_windows(adapters.events(spark, sf_dir))
    fixed = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(f"{c}_e6")
    return found.select("signal", "location", F.col("days").cast("long").alias("days"), "observed", "total", fixed("expected"), fixed("llr"))


@query()
def scan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.scan(adapters.events(spark, sf_dir), replicates=999, max_days=60, report=1.0)


@query("""WITH c AS (SELECT organism, agent, location, count(*) FILTER (result = 'R') AS observed, count(*) AS tested FROM v_ast WHERE result IS NOT NULL GROUP BY ALL),
t AS (SELECT *, sum(observed) OVER w AS cc, sum(tested) OVER w AS nn FROM c WINDOW w AS (PARTITION BY organism, agent)), f AS (SELECT organism, agent, location, observed, tested, observed::DOUBLE AS c, tested::DOUBLE AS n, cc::DOUBLE AS cc, nn::DOUBLE AS nn FROM t WHERE observed >= 3 AND tested >= 10)
SELECT organism, agent, location, observed, tested FROM f WHERE nn > n AND cc < nn AND c / n > (cc - c) / (nn - n)""")
def bernoulli_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = adapters.ast(spark, sf_dir).where("result IS NOT NULL").groupBy("location", "organism", "agent").agg(F.count("*").alias("tested"), F.count_if(F.col("result") == "R").alias("resistant"))
    return detection.bernoulli_scan(cube).select("organism", "agent", "location", "observed", "tested")


@query()
def farrington_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.ast(spark, sf_dir).select(F.col("organism").alias("signal"), F.lit("all").alias("location"), F.col("specimen_date").alias("day"))
    weeks = detection.periods(detection.daily(e).where("location = 'all'"))
    return detection.farrington(weeks.withColumnRenamed("period_end", "day"))


@query()
def bayesian_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detection.prospective_windows(adapters.events(spark, sf_dir), max_days=30)
    return detection.bayesian_scan(found.select("signal", "location", "days", "observed", "expected"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b\d{4}-\d{2}-\d{2}\b', '[DATE]', 'g'),
'\b(?:\+?\d{1,3}[-\s]?)?\(?\d{2,4}\)?[-\s]?\d{3,4}[-\s]?\d{3,4}\b', '[PHONE]', 'g'), '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[EMAIL]', 'g'), '\b[A-Z]{2,}\d{4,}\b', '[ID]', 'g'),
'(?i)(?:patient(?:[_ ]?(?:id|name))?|first[_ ]?name|last[_ ]?name|mrn|uhid|specimen[_ ]?number|dob)\s*[:=]\s*[^,;\n}]+', '[IDENTIFIER]', 'g') AS text FROM documents""")
def text_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "documents").select("doc_id", clinical.redacted(F.col("text")).alias("text"))


@query("""WITH c AS (SELECT conv_id, turn, text, regexp_replace(regexp_replace(text, '\\d{4}-\\d{2}-\\d{2}', 'DATE', 'g'), '[ .()-]', '', 'g') AS joined FROM conversations)
SELECT conv_id, turn FROM c WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') OR regexp_matches(text, '(?:^|\\D)\\d{10,15}(?:\\D|$)') OR regexp_matches(joined, '(?:^|\\D)\\d{10,15}(?:\\D|$)')""")
def identifier_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "conversations").where(clinical.holds_identifier(F.col("text"))).select("conv_id", "turn")


@query(f"""WITH q AS (SELECT lang, count(*) AS denominator, count(*) FILTER (toxic = 1) AS numerator, 1::BIGINT AS n_sites FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, {WILSON} FROM (SELECT *, {Z} FROM q)""")
def labelled_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "labels").join(adapters.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    one = rows.select("lang", F.lit(0).alias("site"), F.col("toxic").cast("long").alias("numerator"), F.lit(1).cast("long").alias("denominator"))
    return federated.rolled_up(one, "lang")


@query("""SELECT o_orderkey AS id, CASE WHEN month(d) >= 7 THEN year(d) ELSE year(d) - 1 END AS reporting_year, year(d + CAST(3 - dayofweek(d) AS INT)) AS epi_year, (dayofyear(d + CAST(3 - dayofweek(d) AS INT)) - 1) // 7 + 1 AS epi_week, weekofyear(d) AS iso_week FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
def calendar_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    year, week = clinical.mmwr_week(day)
    return adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), clinical.reporting_year(day, 7).cast("long").alias("reporting_year"), year.cast("long").alias("epi_year"), week.cast("long").alias("epi_week"), F.weekofyear(day).cast("long").alias("iso_week"))


@query("""WITH c AS (SELECT site, least(5, greatest(0, count(*) / 200.0::DOUBLE)) AS a, least(5, greatest(0, count(DISTINCT organism) / 5.0::DOUBLE)) AS b FROM v_ast GROUP BY site), s AS (SELECT site, a * 0.25::DOUBLE + b * 0.30::DOUBLE + 3 * 0.20::DOUBLE + 2 * 0.15::DOUBLE + 1 * 0.10::DOUBLE AS score FROM c)
SELECT site, floor(score * 1e6 + 0.5)::BIGINT AS score_e6, CASE WHEN score < 1.5 THEN 'low' WHEN score < 2.5 THEN 'moderate' WHEN score < 3.5 THEN 'high' ELSE 'critical' END AS rating FROM s""")
def joint_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.ast(spark, sf_dir).groupBy("site").agg((F.count("*") / 200.0).alias("a"), (F.countDistinct("organism") / 5.0).alias("b"))
    score, rating = stats.risk_rating(F.col("a"), F.col("b"), F.lit(3), F.lit(2), F.lit(1))
    return c.select("site", F.floor(score * 1e6 + 0.5).cast("long").alias("score_e6"), rating.alias("rating"))
