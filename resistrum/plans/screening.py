"""Queries of the screening and evaluation operators, and SQL that says what each returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resistrum.operators import evaluation, screening
from resistrum.plans.analysis import query
from resistrum.sources import adapters
from resistrum.sources.shared import written


@query("""SELECT isolate_id, organism, specimen_date FROM v_isolate WHERE lower(trim(location)) IN ('nation_3', 'nation_7') AND lower(organism) LIKE '%brand#1%'
AND specimen_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'""")
def record_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = screening.record_filter(adapters.isolates(spark, sf_dir), {"location": [" Nation_3", "NATION_7"], "specimen": []}, {"organism": ["brand#1"]}, ("specimen_date", "1994-01-01", "1996-12-31"))
    return found.select("isolate_id", "organism", "specimen_date")


@query("SELECT organism AS label, count(*) AS value FROM v_isolate WHERE contains(lower(organism), 'brand#2') OR contains(lower(organism), 'brand#3') GROUP BY organism HAVING count(*) >= 40")
def bucket_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = adapters.isolates(spark, sf_dir).groupBy(F.col("organism").alias("label")).agg(F.count("*").alias("value"))
    return screening.bucket_filter(buckets, ["Brand#2", "brand#3"], 40)


@query("SELECT isolate_id FROM v_isolate WHERE contains(lower(specimen), 'urgent') AND contains(lower(organism), 'brand#1') AND NOT contains(lower(organism), 'bacillus anthracis')")
def contaminants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.isolates(spark, sf_dir).withColumn("sample", F.regexp_replace("specimen", "(?i)urgent", "blood"))
    return d.where(screening.blood_contaminant("sample", "organism", ("brand#1",))).select("isolate_id")


@query("SELECT isolate_id FROM v_isolate WHERE greatest(coalesce(strftime(specimen_date, '%Y-%m-%d'), ''), coalesce(strftime(admission_date, '%Y-%m-%d'), '')) < '1995-06-01' AND (specimen_date IS NOT NULL OR admission_date IS NOT NULL)")
def expired_isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.isolates(spark, sf_dir).where(screening.expired(["specimen_date", "admission_date"], "1995-06-01")).select("isolate_id")


@query("""WITH r AS (SELECT site, 100.0::DOUBLE * count(*) FILTER (result = 'R') / count(result) AS rate FROM v_ast WHERE result IS NOT NULL GROUP BY site)
SELECT site, rate, 'gt' AS rule FROM r WHERE rate > 26 UNION ALL SELECT site, rate, 'lte' FROM r WHERE rate <= 23.5""")
def threshold_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = adapters.ast(spark, sf_dir).where("result IS NOT NULL").groupBy("site").agg((100.0 * F.count_if(F.col("result") == "R") / F.count("result")).alias("rate"))
    rules = F.explode(F.array(F.struct(F.lit("gt").alias("rule"), F.lit(26.0).alias("limit")), F.struct(F.lit("lte").alias("rule"), F.lit(23.5).alias("limit"))))
    return rates.select("site", "rate", rules.alias("r")).select("site", "rate", "r.rule", "r.limit").where(screening.breached(F.col("rate"), F.col("rule"), F.col("limit"))).drop("limit")


#: Six agents, and few of them resistant.
_FEW = "SELECT order_key, organism, string_split(agent, ' ')[1] AS agent, CASE WHEN result = 'R' AND line % 4 <> 0 THEN 'I' ELSE result END AS result FROM v_ast"


@query(f"""WITH d AS ({_FEW}), k AS (SELECT order_key, organism, agent, max(result) AS result FROM d WHERE result IS NOT NULL GROUP BY ALL),
i AS (SELECT organism, count(DISTINCT order_key) - 1 AS history FROM d GROUP BY ALL), c AS (SELECT organism, agent, count(*) - 1 AS tested, count(*) FILTER (result = 'R') AS r, count(*) FILTER (result = 'S') AS s FROM k GROUP BY ALL),
f AS (SELECT *, CASE result WHEN 'R' THEN r WHEN 'S' THEN s END - 1 AS same FROM k JOIN c USING (organism, agent) JOIN i USING (organism) WHERE history >= 20)
SELECT order_key, organism, agent, result, history, tested, 'result' AS alert FROM f WHERE tested >= 20 AND 100 * same < 17 * tested
UNION ALL SELECT order_key, organism, agent, result, history, tested, 'test' FROM f WHERE tested > 0 AND 100 * tested < 17 * history""")
def rare_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = F.when((F.col("result") == "R") & (F.col("line") % 4 != 0), "I").otherwise(F.col("result"))
    d = adapters.ast(spark, sf_dir).select("order_key", "organism", F.split("agent", " ")[0].alias("agent"), few.alias("result"))
    return screening.rare_results(d, ["organism"], "order_key", 20, 17.0)


#: Identities asked for in other case and spacing, without a key, or that no record has.
_ASKED = "CASE WHEN isolate_id % 7 = 0 THEN NULL WHEN isolate_id % 3 = 0 THEN ' p' || patient || ' ' WHEN isolate_id % 5 = 0 THEN 'Q' || patient ELSE 'P' || patient END"


@query(f"""WITH r AS (SELECT isolate_id, 'lab-' || site AS lab, 'P' || patient AS patient FROM v_isolate), w AS (SELECT DISTINCT 'LAB-' || site AS lab, {_ASKED} AS patient FROM v_isolate),
o AS (SELECT lab, patient, min(isolate_id) AS isolate_id FROM r GROUP BY ALL)
SELECT w.lab, w.patient, o.isolate_id FROM w LEFT JOIN o ON lower(w.lab) = o.lab AND lower(trim(w.patient)) = lower(o.patient)""")
def identity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = written(adapters.isolates(spark, sf_dir).select("isolate_id", "site", "patient"), "isolates")
    records = d.select("isolate_id", F.concat(F.lit("lab-"), "site").alias("lab"), F.concat(F.lit("P"), "patient").alias("patient"))
    wanted = d.select(F.concat(F.lit("LAB-"), "site").alias("lab"), F.expr(_ASKED).alias("patient")).distinct()
    return screening.identified(records, wanted, ["lab", "patient"])


@query("""WITH q AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN [] ELSE [p_partkey % 7, p_partkey % 5, -1] END AS targets, p_partkey % 3 <> 0 AS active, p_partkey % 5 = 0 AS expired FROM part WHERE p_size = 1),
s AS (SELECT s_suppkey AS site FROM supplier), c AS (SELECT DISTINCT query_id, site FROM q JOIN s ON targets IS NULL OR list_contains(targets, site) WHERE active AND NOT expired)
SELECT query_id, site FROM c WHERE (query_id + site) % 3 <> 0""")
def pending_dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, sites = adapters.table(spark, sf_dir, "part").where("p_size = 1"), adapters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"))
    k = F.col("p_partkey")
    targets = F.when(k % 4 == 1, F.array().cast("array<bigint>")).when(k % 4 != 0, F.array(k % 7, k % 5, F.lit(-1).cast("long")))
    expires = F.when(k % 5 == 0, F.lit("2026-01-01")).when(k % 5 == 1, F.lit("2027-01-01")).cast("timestamp")
    queries = part.select(k.alias("query_id"), targets.alias("targets"), F.when(k % 3 != 0, "active").otherwise("closed").alias("status"), expires.alias("expires_at"))
    # those sent before: a third of the pairs; as many are only pending
    state = F.when((F.col("query_id") + F.col("site")) % 3 == 0, "sent").when((F.col("query_id") + F.col("site")) % 3 == 1, "pending")
    sent = screening.pending(queries, queries.select("query_id", F.lit(None).cast("long").alias("site")).limit(0), sites, "2026-06-01").withColumn("status", state).where("status IS NOT NULL")
    return screening.pending(queries, sent, sites, "2026-06-01")


CLUSTERS = "SELECT row_number() OVER (ORDER BY signal, location) AS cluster_id, CASE WHEN location = 'L1' THEN NULL ELSE location END AS location, signal, min(day) AS begin, min(day) + INTERVAL 3 DAY AS \"end\" FROM v_event GROUP BY signal, location"


@query(f"WITH c AS ({CLUSTERS}) SELECT event_id, cluster_id FROM v_event e JOIN c ON e.signal = c.signal AND e.day >= c.begin AND e.day <= c.\"end\" AND (c.location IS NULL OR c.location = e.location)")
def cases_in_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.events(spark, sf_dir)
    return screening.cases_in_clusters(e, _clusters(e)).select("event_id", "cluster_id")


def _clusters(events: DataFrame) -> DataFrame:
    groups = events.groupBy("signal", "location").agg(F.min("day").alias("begin"))
    ids = F.row_number().over(Window.orderBy("signal", "location")).cast("long")
    return groups.select(ids.alias("cluster_id"), F.when(F.col("location") != "L1", F.col("location")).alias("location"), "signal", "begin", F.date_add("begin", 3).alias("end"))


@query("""WITH s AS (SELECT site AS child, 100.0::DOUBLE * count(*) FILTER (result = 'R') / nullif(count(result), 0) AS rate FROM v_ast GROUP BY site) SELECT child, rate FROM s ORDER BY rate DESC NULLS LAST, child LIMIT 20""")
def ranked_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.try_divide(100.0 * F.count_if(F.col("result") == "R"), F.count("result"))
    return screening.ranked_children(adapters.ast(spark, sf_dir).groupBy(F.col("site").alias("child")).agg(rate.alias("rate")))


@query("SELECT s_suppkey AS site, CASE WHEN lower(trim(s_name)) = 'supplier#000000001' THEN 0 WHEN starts_with(lower(trim(s_name)), 'supplier#000000001') THEN 1 WHEN contains(lower(trim(s_name)), 'supplier#000000001') THEN 2 END AS rank FROM supplier WHERE contains(lower(trim(s_name)), 'supplier#000000001')")
def place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), screening.place_rank(F.col("s_name"), "Supplier#000000001").cast("int").alias("rank")).where("rank IS NOT NULL")


@query("""WITH p AS (SELECT DISTINCT admin_path, string_split(admin_path, '/') AS x FROM v_ast WHERE admin_path IS NOT NULL)
SELECT DISTINCT array_to_string(x[1:k], '/') AS prefix, (k - 1)::BIGINT AS level FROM (SELECT x, unnest(range(1, len(x) + 1)) AS k FROM p)""")
def path_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.path_prefixes(adapters.ast(spark, sf_dir))


@query("SELECT conv_id AS rule, role AS message, max(turn) AS alert_id FROM conversations GROUP BY conv_id, role")
def newest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.newest_alerts(adapters.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rule"), F.col("role").alias("message"), F.col("turn").alias("alert_id")))


@query("SELECT location, avg(value) AS mean, stddev_pop(value) AS sd, count(value) AS n FROM v_event GROUP BY location")
def null_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.moments(adapters.events(spark, sf_dir).withColumnRenamed("value", "llr"), "location")


@query("""WITH v AS (SELECT location, patient % 40 AS part, value FROM v_event), g AS (SELECT location, part, count(value) AS nulls FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY location, part ORDER BY value DESC) AS k FROM v WHERE value IS NOT NULL)
SELECT location, part, nulls, coalesce(value, '-infinity'::DOUBLE) AS threshold FROM g LEFT JOIN (SELECT location, part, value FROM r WHERE k = 26) USING (location, part)""")
def calibrated_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.events(spark, sf_dir).select("location", (F.col("patient") % 40).alias("part"), F.col("value").alias("llr"))
    return evaluation.calibrated(d, 25, "location", "part")


@query("""WITH d AS (SELECT location, floor(value)::DOUBLE AS x, (event_id % 17)::DOUBLE AS y FROM v_event WHERE value IS NOT NULL),
r AS (SELECT location, rank() OVER (PARTITION BY location ORDER BY x) + (count(*) OVER (PARTITION BY location, x) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER (PARTITION BY location ORDER BY y) + (count(*) OVER (PARTITION BY location, y) - 1) / 2.0::DOUBLE AS ry FROM d)
SELECT location, floor(corr(rx, ry) * 1e6 + 0.5)::BIGINT AS rho_e6, count(*) AS n FROM r GROUP BY location""")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.events(spark, sf_dir).select("location", F.floor("value").cast("double").alias("x"), (F.col("event_id") % 17).cast("double").alias("y"))
    return evaluation.spearman(d, "location").select("location", F.floor(F.col("rho") * 1e6 + 0.5).cast("long").alias("rho_e6"), "n")


@query("""WITH d AS (SELECT signal, value - (event_id % 17) AS d FROM v_event WHERE value IS NOT NULL), a AS (SELECT signal, avg(d) AS bias, stddev_samp(d) AS sd, count(*) AS n FROM d GROUP BY signal)
SELECT signal, n, floor(bias * 1e6 + 0.5)::BIGINT AS bias_e6, floor((bias - 1.96::DOUBLE * sd) * 1e6 + 0.5)::BIGINT AS low_e6, floor((bias + 1.96::DOUBLE * sd) * 1e6 + 0.5)::BIGINT AS high_e6 FROM a""")
def limits_of_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evaluation.bland_altman(adapters.events(spark, sf_dir).select("signal", F.col("value").alias("x"), (F.col("event_id") % 17).alias("y")), "signal")
    return d.select("signal", "n", *[F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(f"{c}_e6") for c in ("bias", "low", "high")])


@query("SELECT count(DISTINCT specimen_date) AS n_days, count(DISTINCT location) AS n_locations, count(DISTINCT organism) AS n_organisms, count(DISTINCT agent) AS n_agents, count(result) AS tested, count(*) FILTER (result = 'R') AS resistant FROM v_ast")
def denominator_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.ast(spark, sf_dir).groupBy(F.col("specimen_date").alias("day"), "location", "organism", "agent").agg(F.count("result").alias("tested"), F.count_if(F.col("result") == "R").alias("resistant"))
    return evaluation.denominator_coverage(d)


@query("""WITH RECURSIVE d AS (SELECT location, signal, day, count(*) FILTER (value > 50) AS cases, count(*) AS tested, row_number() OVER (PARTITION BY location, signal ORDER BY day) AS k FROM v_event GROUP BY 1, 2, 3),
w AS (SELECT *, cases * ln(0.5::DOUBLE / 0.25) + (tested - cases) * ln(0.5::DOUBLE / 0.75) AS w FROM d),
s AS (SELECT location, signal, day, k, greatest(0.0::DOUBLE, w) AS s FROM w WHERE k = 1 UNION ALL SELECT w.location, w.signal, w.day, w.k, greatest(0.0::DOUBLE, s.s + w.w) FROM s JOIN w ON w.location = s.location AND w.signal = s.signal AND w.k = s.k + 1)
SELECT location, signal, day, floor(s * 1e6 + 0.5)::BIGINT AS cusum_e6 FROM s""")
def bernoulli_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapters.events(spark, sf_dir).groupBy("location", "signal", "day").agg(F.count_if(F.col("value") > 50).alias("cases"), F.count("*").alias("tested"))
    return evaluation.bernoulli_cusum(d, 0.25, 0.5).select("location", "signal", "day", F.floor(F.col("cusum") * 1e6 + 0.5).cast("long").alias("cusum_e6"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL),
n AS (SELECT *, sha256('{"role":"' || role || '","turn":' || turn || '}') AS digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t),
h AS (
  SELECT conv_id, k, turn, role, digest, '' AS previous_hash, sha256('{"conv_id":' || conv_id || ',"details_digest":"' || digest || '","turn":' || turn || '}') AS hash FROM n WHERE k = 1
  UNION ALL
  SELECT n.conv_id, n.k, n.turn, n.role, n.digest, h.hash, sha256(h.hash || '{"conv_id":' || n.conv_id || ',"details_digest":"' || n.digest || '","turn":' || n.turn || '}') FROM h JOIN n ON n.conv_id = h.conv_id AND n.k = h.k + 1
),
f AS (SELECT conv_id, k, turn, digest, previous_hash, CASE WHEN turn % 5 = 3 THEN 'forged' ELSE hash END AS hash, CASE WHEN turn % 4 = 2 THEN 'x' ELSE role END AS role, turn % 3 = 2 AS erased FROM h),
v AS (SELECT *, coalesce(lag(hash) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before, sha256(previous_hash || '{"conv_id":' || conv_id || ',"details_digest":"' || digest || '","turn":' || turn || '}') AS own, sha256('{"role":"' || role || '","turn":' || turn || '}') AS now FROM f),
r AS (SELECT conv_id, turn AS seq, CASE WHEN previous_hash <> before THEN 'link' WHEN hash <> own THEN 'entry' WHEN NOT erased AND digest <> now THEN 'details' END AS reason FROM v)
SELECT conv_id, seq, reason FROM r WHERE reason IS NOT NULL""")
def broken_audit_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of entries for each conversation, in which hashes are forged and details changed, some of them erased before."""
    t = adapters.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    d = t.withColumn("details_digest", evaluation.details_digest(evaluation.canonical(["role", "turn"]))).withColumn("_entry", evaluation.canonical(["conv_id", "details_digest", "turn"]))
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["details_digest"].alias("details_digest"), F.coalesce(F.try_element_at(acc, F.lit(-1))["hash"], F.lit("")).alias("previous_hash"), evaluation.entry_hash(F.try_element_at(acc, F.lit(-1))["hash"], x["_entry"]).alias("hash"))))
    none = F.array().cast("array<struct<turn: bigint, role: string, details_digest: string, previous_hash: string, hash: string>>")
    entries = F.array_sort(F.collect_list(F.struct("turn", "role", "details_digest", "_entry")))
    chain = d.groupBy("conv_id").agg(entries.alias("e")).select("conv_id", F.explode(F.aggregate("e", none, step)).alias("x")).select("conv_id", "x.*")
    forged = chain.withColumns({"hash": F.when(F.col("turn") % 5 == 3, "forged").otherwise(F.col("hash")), "role": F.when(F.col("turn") % 4 == 2, "x").otherwise(F.col("role")), "erased_at": F.when(F.col("turn") % 3 == 2, "2026-01-01")})
    return evaluation.broken_links(forged.withColumns({"details": evaluation.canonical(["role", "turn"]), "seq": F.col("turn")}), ["conv_id", "turn"], "conv_id")
