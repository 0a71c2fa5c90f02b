"""Queries of the catalogue of measures, of payloads and of distributions, and SQL that says what each returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resistrum.functions import clinical, distributions, payload
from resistrum.operators import cohort, detection, metrics, places, screening, susceptibility
from resistrum.plans.analysis import query
from resistrum.plans.scanning import e6
from resistrum.sources import adapters
from resistrum.sources.shared import written

#: Names of organisms and agents for the brands and types of parts, the same in both dialects.
_NAMED = """CASE organism WHEN 'Brand#11' THEN 'Escherichia coli' WHEN 'Brand#12' THEN 'Klebsiella pneumoniae' WHEN 'Brand#13' THEN 'Staphylococcus aureus' WHEN 'Brand#21' THEN 'Enterococcus faecium'
WHEN 'Brand#22' THEN 'Pseudomonas aeruginosa' WHEN 'Brand#23' THEN 'Acinetobacter baumannii' WHEN 'Brand#31' THEN 'Salmonella Typhi' ELSE organism END AS organism,
CASE WHEN agent LIKE 'ECONOMY%' THEN 'MEM' WHEN agent LIKE 'STANDARD%' THEN 'CRO' WHEN agent LIKE 'SMALL%' THEN 'CIP' WHEN agent LIKE 'MEDIUM%' THEN 'COL' WHEN agent LIKE 'LARGE%' THEN 'OXA' ELSE 'VAN' END AS agent,
CASE WHEN specimen LIKE '1%' THEN 'Blood culture' ELSE specimen END AS specimen"""
_TESTED = f"SELECT site, admin_path, year(specimen_date) AS year, result, {_NAMED} FROM {{ast}} WHERE result IS NOT NULL"
#: Each site's answers of each year: rates by organism and agent, of blood, and of all; numbers of isolates and their mix.
_ANSWERS = """
SELECT site, 'resistance_rate' AS query_type, agent, organism, '' AS specimen, year, count(*) AS denominator, sum(CASE WHEN result = 'R' THEN 1 ELSE 0 END) AS numerator, 0 AS total FROM {t} GROUP BY site, agent, organism, year
UNION ALL SELECT site, 'resistance_rate', agent, organism, 'Blood', year, count(*), sum(CASE WHEN result = 'R' THEN 1 ELSE 0 END), 0 FROM {t} WHERE specimen LIKE 'Blood%' GROUP BY site, agent, organism, year
UNION ALL SELECT site, 'resistance_rate', 'MEM', '', '', year, count(*), sum(CASE WHEN result = 'R' THEN 1 ELSE 0 END), 0 FROM {t} GROUP BY site, year
UNION ALL SELECT site, 'isolate_count', '', '', '', year, 0, 0, count(*) FROM {t} GROUP BY site, year
"""


def _site_sql(name: str, literal: str) -> str:
    return f"SELECT DISTINCT site, admin_path, CASE WHEN site % 10 = 0 THEN 'closed' ELSE 'active' END AS status, {literal} AS last_seen_at FROM {name}"


@query(f"""WITH t AS ({_TESTED.format(ast="v_ast")}), a AS ({_ANSWERS.format(t="t")}), sites AS ({_site_sql("v_ast", "CASE WHEN site % 3 = 0 THEN TIMESTAMP '2026-01-01 11:57:00' ELSE TIMESTAMP '2026-01-01 11:50:00' END")}),
c(metric, family, o, g, s) AS (VALUES {", ".join(f"('{k}', 'resistance', '{o.split()[0].lower()}', '{a}', '{s}')" for k, o, a, s in metrics.RESISTANCE)}, {", ".join(f"('{k}', 'phenotype', '', '', '')" for k in metrics.PHENOTYPES)}),
r AS (SELECT metric, family, site, year, numerator, denominator FROM a JOIN c ON query_type = 'resistance_rate' AND (g = '' OR g = agent) AND (CASE WHEN o <> '' THEN contains(lower(organism), o) ELSE organism = '' END) AND (CASE WHEN s <> '' THEN contains(lower(specimen), s) ELSE specimen = '' END)),
last AS (SELECT metric, family, site, NULL::VARCHAR AS label, arg_max(numerator, (year, denominator, numerator)) AS num, arg_max(denominator, (year, denominator, numerator)) AS den, NULL::VARCHAR AS unit FROM r GROUP BY ALL),
mix AS (
  SELECT 'burden_organism_mix' AS metric, site, organism AS label, count(*) AS num FROM t x WHERE year = (SELECT max(year) FROM t y WHERE y.site = x.site) GROUP BY ALL
  UNION ALL SELECT 'burden_specimen_mix', site, specimen, count(*) FROM t x WHERE year = (SELECT max(year) FROM t y WHERE y.site = x.site) GROUP BY ALL
  UNION ALL SELECT 'burden_isolates', site, NULL, arg_max(total, year) FROM a WHERE query_type = 'isolate_count' GROUP BY ALL
),
parts AS (SELECT *, string_split(admin_path, '/') AS p FROM sites),
every AS (
  SELECT * FROM last UNION ALL SELECT metric, 'burden', site, label, num, NULL, NULL FROM mix
  UNION ALL SELECT 'cov_sites_reporting', 'coverage', site, NULL, (site IN (SELECT site FROM a))::BIGINT, 1, NULL FROM sites WHERE status = 'active'
  UNION ALL SELECT 'cov_sites_online', 'coverage', site, NULL, (last_seen_at >= TIMESTAMP '2026-01-01 11:55:00')::BIGINT, 1, NULL FROM sites WHERE status = 'active'
  UNION ALL SELECT 'cov_ast_completeness', 'coverage', site, NULL, NULL, 1, NULL FROM sites WHERE status = 'active'
  UNION ALL SELECT 'cov_geo', 'coverage', site, 'admin' || (k - 1), 1, NULL, array_to_string(p[1:k], '/') FROM (SELECT *, unnest(range(2, len(p) + 1)) AS k FROM parts WHERE status = 'active')
),
scopes AS (SELECT site, 'global' AS scope_type, '' AS scope_value FROM parts UNION ALL SELECT site, 'site', site::VARCHAR FROM parts UNION ALL SELECT site, 'admin' || (k - 1), array_to_string(p[1:k], '/') FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM parts)),
s AS (SELECT metric, family, scope_type, scope_value, label, CASE WHEN metric = 'cov_geo' THEN count(DISTINCT unit) ELSE sum(num) END::BIGINT AS numerator, sum(den)::BIGINT AS denominator, count(DISTINCT CASE WHEN family = 'burden' OR den > 0 THEN site END) AS n_sites FROM every JOIN scopes USING (site) GROUP BY metric, family, scope_type, scope_value, label),
w AS (SELECT *, numerator::DOUBLE AS x, denominator::DOUBLE AS n, numerator::DOUBLE / denominator AS p, 1.959963984540054::DOUBLE AS z FROM s WHERE label IS NULL OR metric = 'cov_geo' OR numerator >= 5)
SELECT metric, scope_type, scope_value, label, numerator, denominator, n_sites, CASE WHEN n > 0 THEN round(100.0::DOUBLE * x / n, CASE WHEN family = 'coverage' THEN 1 ELSE 2 END) END AS rate_percent,
       CASE WHEN family IN ('resistance', 'phenotype') THEN round(100 * greatest(0, (p + z * z / (2 * n) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 2) END AS ci_low_percent,
       CASE WHEN family IN ('resistance', 'phenotype') THEN round(100 * least(1, (p + z * z / (2 * n) + z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 2) END AS ci_high_percent
FROM w""")
def metric_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of the catalogue, at all scopes."""
    ast = adapters.ast(spark, sf_dir)
    t = written(spark.sql(_TESTED, ast=ast), "tested")  # every answer is made of it
    none = F.lit(None).cast("map<string,bigint>")
    plain = spark.sql(_ANSWERS.format(t="{t}"), t=t).withColumn("buckets", none)
    for kind, c in (("organism_distribution", "organism"), ("specimen_distribution", "specimen")):
        counts = t.groupBy("site", "year", c).agg(F.count("*").alias("n")).groupBy("site", "year").agg(F.map_from_entries(F.collect_list(F.struct(c, "n"))).alias("buckets"))
        plain = plain.unionByName(counts.select("site", F.lit(kind).alias("query_type"), *[F.lit("").alias(x) for x in ("agent", "organism", "specimen")], "year", *[F.lit(0).alias(x) for x in ("denominator", "numerator", "total")], "buckets"))
    answers = plain.withColumns({"ok": F.lit(True), "received_at": F.make_date("year", F.lit(12), F.lit(31)).cast("timestamp")})
    sites = spark.sql(_site_sql("{ast}", "CASE WHEN site % 3 = 0 THEN TIMESTAMP '2026-01-01 11:57:00' ELSE TIMESTAMP '2026-01-01 11:50:00' END"), ast=t)
    return metrics.measured(answers, sites, metrics.catalogue(spark), "2026-01-01 12:00:00")


#: JSON of each turn, with keys in several spellings, contents, and codes beside a system that makes them no identifiers or not; the same in both dialects.
_PAYLOAD = """concat('{"', CASE turn % 7 WHEN 0 THEN 'patientName' WHEN 1 THEN 'status' WHEN 2 THEN 'Postal-Code' WHEN 3 THEN 'addressLine2' WHEN 4 THEN 'GPS' WHEN 5 THEN 'notes' ELSE 'guardian ref' END, '":{"name":"', role, '","items":[{"value":"',
CASE conv_id % 4 WHEN 0 THEN 'call +91 98765 43210' WHEN 1 THEN 'on 2026-01-12' WHEN 2 THEN 'a.b@example.org' ELSE 'nothing' END, '"},{"code":"1234567890","system":"', CASE conv_id % 3 WHEN 0 THEN 'http://loinc.org' ELSE 'urn:local' END, '"},[[{"dateOfBirth":null}],', CAST(turn AS STRING), ']]}}')"""


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = adapters.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return turns.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.expr(_PAYLOAD).alias("payload"))


_TREE = f"""t AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL), p AS (SELECT conv_id || '/' || turn AS id, {_PAYLOAD.replace("AS STRING", "AS VARCHAR")} AS payload FROM t),
tree AS (SELECT p.id, replace(j.fullkey, '"', '') AS path, replace(j.path, '"', '') AS above, CASE WHEN j.key ~ '^[0-9]+$' THEN NULL ELSE j.key END AS name, j.type AS type, j.atom ->> '$' AS text FROM p, json_tree(p.payload) AS j)"""
_BANNED_SQL = f"(k IN ({', '.join(repr(k) for k in payload.BANNED)}) OR {' OR '.join(f'starts_with(k, {s!r})' for s in payload.STEMS)})"


@query(f"""WITH {_TREE},
n AS (SELECT *, replace(replace(lower(regexp_replace(trim(name), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '-', '_'), ' ', '_') AS k FROM tree),
s AS (SELECT n.*, x.text AS system FROM n LEFT JOIN tree x ON x.id = n.id AND x.above = n.above AND x.name = 'system' AND n.name IS NOT NULL),
b AS (SELECT *, coalesce({_BANNED_SQL}, false) AS banned, coalesce(k = 'code' AND system = 'http://loinc.org', false) AS safe, regexp_replace(regexp_replace(text, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b', ' ', 'g'), '[\\s().-]', '', 'g') AS joined FROM s),
h AS (SELECT id, path, banned, banned OR safe AS stops, NOT safe AND type = 'VARCHAR' AND (regexp_matches(text, '\\b\\d{{10,15}}\\b') OR regexp_matches(joined, '\\b\\d{{10,15}}\\b') OR regexp_matches(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}\\b')) AS content FROM b)
SELECT id, CASE WHEN banned THEN path ELSE path || '~content' END AS path FROM h WHERE (banned OR content) AND NOT EXISTS (SELECT 1 FROM h x WHERE x.id = h.id AND x.stops AND x.path <> h.path AND (starts_with(h.path, x.path || '.') OR starts_with(h.path, x.path || '[')))""")
def payload_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.violations(_payloads(spark, sf_dir), "id", "payload")


@query(f"WITH {_TREE} SELECT DISTINCT id FROM tree WHERE lower(name) IN ('gps', 'dateofbirth', 'status') AND NOT (lower(name) = 'dateofbirth' AND id LIKE '%3')")
def payload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _payloads(spark, sf_dir).withColumn("payload", F.when(F.col("id").endswith("3"), F.replace("payload", F.lit("dateOfBirth"), F.lit("date"))).otherwise(F.col("payload")))
    return payload.holds_key(some, "id", "payload", ("gps", "dateofbirth", "status"))


@query("""WITH d AS (SELECT location, signal, day, count(*) AS n FROM v_event GROUP BY ALL), m AS (SELECT location, signal, avg(n) AS mean, max(n) AS k, 2.0::DOUBLE + min(n) AS size FROM d GROUP BY ALL),
c AS (SELECT *, list_transform(range(0, 400), lambda i: exp(i * ln(mean) - mean - lgamma(i + 1))) AS po, list_transform(range(0, 400), lambda i: exp(lgamma(i + size) - lgamma(size) - lgamma(i + 1) + size * ln(size / (size + mean)) + i * ln(mean / (size + mean)))) AS nb FROM m)
SELECT location, signal, k, floor(list_sum(po[1:k + 1]) * 1e6 + 0.5)::BIGINT AS poisson_e6, floor(list_sum(nb[1:k + 1]) * 1e6 + 0.5)::BIGINT AS binomial_e6,
       len(list_filter(range(1, 400), lambda j: list_sum(po[1:j]) < 0.975)) AS poisson_bound, len(list_filter(range(1, 400), lambda j: list_sum(nb[1:j]) < 0.995)) AS binomial_bound FROM c""")
def count_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unusual each series' highest day is, and the counts that its days would rarely pass."""
    days = adapters.events(spark, sf_dir).groupBy("location", "signal", "day").agg(F.count("*").alias("n"))
    m = days.groupBy("location", "signal").agg(F.avg("n").alias("mean"), F.max("n").alias("k"), (2.0 + F.min("n")).alias("size"))
    k, mean, size = F.col("k"), F.col("mean"), F.col("size")
    found = m.withColumns({
        "poisson": distributions.poisson_probability(k, mean), "binomial": distributions.negative_binomial_probability(k, size, mean), "poisson_bound": distributions.poisson_quantile(F.lit(0.975), mean), "binomial_bound": distributions.negative_binomial_quantile(F.lit(0.995), size, mean),
    })
    return found.select("location", "signal", "k", e6("poisson"), e6("binomial"), "poisson_bound", "binomial_bound")


#: Names for brands, types and priorities that the lists of indicators and contaminants know; the same in both dialects.
_SPECIES = {
    "Brand#1": "Escherichia coli", "Brand#2": "Klebsiella pneumoniae", "Brand#3": "S. aureus (MSSA?)", "Brand#4": "Enterococcus faecium", "Brand#5": "Pseudomonas aeruginosa", "Brand#6": "Acinetobacter baumannii", "Brand#7": "Streptococcus pneumoniae",
    "Brand#8": "Staphylococcus epidermidis", "Brand#9": "Bacillus cereus", "Brand#10": "Bacillus anthracis", "Brand#11": "Serratia marcescens", "Brand#12": "Micrococcus luteus", "Brand#13": "CORYNEBACTERIUM striatum",
}
_CODES = {"ECONOMY": "MEM", "STANDARD": "CRO", "SMALL": "CIP", "MEDIUM": "VAN", "LARGE": "OXA", "PROMO": "PEN"}


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in names.items())} ELSE {column} END"


_CODED = f"SELECT concat(CAST(order_key AS {{text}}), '-', organism) AS isolate_id, {_case('organism', _SPECIES)} AS organism, {_case('agent', _CODES)} AS agent, CASE WHEN specimen LIKE '1%' THEN 'Whole BLOOD' ELSE specimen END AS specimen, result FROM {{ast}}"


@query(f"""WITH d AS ({_CODED.format(ast="v_ast", text="VARCHAR")}), i(label, tokens, agents, positive) AS (VALUES {", ".join(f"('{x.label}', {list(x.organisms)}, {list(x.agents)}, {list(x.positive)})" for x in susceptibility.INDICATORS)}),
m AS (SELECT label, isolate_id, bool_or(list_contains(positive, result)) AS hit FROM d JOIN i ON list_contains(agents, agent) AND len(list_filter(tokens, lambda t: contains(lower(organism), t))) > 0 WHERE result IS NOT NULL GROUP BY ALL)
SELECT label, count(*) AS denominator, count(*) FILTER (hit) AS numerator, 100.0::DOUBLE * count(*) FILTER (hit) / count(*) AS pct FROM m GROUP BY label""")
def named_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priority indicators themselves, on organisms and agents that they know."""
    return susceptibility.indicators(spark.sql(_CODED.format(ast="{ast}", text="STRING"), ast=adapters.ast(spark, sf_dir)))


@query(f"""WITH d AS ({_CODED.format(ast="v_ast", text="VARCHAR")}) SELECT DISTINCT isolate_id, organism FROM d WHERE contains(lower(specimen), 'blood') AND NOT contains(lower(organism), 'bacillus anthracis')
AND ({" OR ".join(f"contains(lower(organism), '{t}')" for t in screening.CONTAMINANTS)})""")
def named_contaminants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.sql(_CODED.format(ast="{ast}", text="STRING"), ast=adapters.ast(spark, sf_dir))
    return d.where(screening.blood_contaminant("specimen", "organism")).select("isolate_id", "organism").distinct()


@query("""WITH c AS (SELECT isolate_id, site, patient, organism, specimen, specimen_date FROM v_isolate UNION ALL SELECT isolate_id + 1000000000, site, CASE WHEN isolate_id % 15 = 0 THEN NULL ELSE patient END, organism, specimen, specimen_date + CAST(isolate_id % 2 AS INT) FROM v_isolate WHERE isolate_id % 5 = 0),
k AS (SELECT *, min(isolate_id) OVER (PARTITION BY site, patient, organism, specimen, specimen_date) AS duplicate_of FROM c WHERE patient IS NOT NULL AND site IS NOT NULL AND specimen IS NOT NULL AND specimen_date IS NOT NULL)
SELECT isolate_id, organism, duplicate_of FROM k WHERE duplicate_of <> isolate_id""")
def resent_isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates among isolates of which every fifth came again, some a day later or without its patient."""
    d = adapters.isolates(spark, sf_dir).select("isolate_id", "site", "patient", "organism", "specimen", "specimen_date")
    k = F.col("isolate_id")
    again = d.where(k % 5 == 0).withColumns({"isolate_id": k + 1_000_000_000, "patient": F.when(k % 15 != 0, F.col("patient")), "specimen_date": F.date_add("specimen_date", (k % 2).cast("int"))})
    return cohort.duplicates(d.union(again.select(d.columns))).select("isolate_id", "organism", "duplicate_of")


_WRITTEN = "concat(text, CASE turn % 6 WHEN 0 THEN ' call +91 98765-43210' WHEN 1 THEN ' on 2026-01-12 12:30' WHEN 2 THEN ' to a.b@example.org' WHEN 3 THEN ' no 123456789' WHEN 4 THEN ' (0123) 456 7890' ELSE ' 12345678901234567' END)"


@query(f"""WITH c AS (SELECT conv_id, turn, {_WRITTEN} AS text FROM conversations), j AS (SELECT *, regexp_replace(regexp_replace(text, '\\d{{4}}-\\d{{2}}-\\d{{2}}', 'DATE', 'g'), '[ .()-]', '', 'g') AS joined FROM c)
SELECT conv_id, turn FROM j WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') OR regexp_matches(text, '(?:^|\\D)\\d{{10,15}}(?:\\D|$)') OR regexp_matches(joined, '(?:^|\\D)\\d{{10,15}}(?:\\D|$)')""")
def written_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that hold an identifier, among turns to which identifiers and harmless numbers were added."""
    return adapters.table(spark, sf_dir, "conversations").withColumn("text", F.expr(_WRITTEN)).where(clinical.holds_identifier(F.col("text"))).select("conv_id", "turn")


@query()
def farrington_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly regression with the bound of a negative binomial count."""
    e = adapters.ast(spark, sf_dir).select(F.col("organism").alias("signal"), F.lit("all").alias("location"), F.col("specimen_date").alias("day"))
    weeks = detection.periods(detection.daily(e).where("location = 'all'"))
    return detection.farrington(weeks.withColumnRenamed("period_end", "day"), bound="negative-binomial")


#: Countries, units, postal codes, localities and addresses drawn from the star schema, the same in both dialects.
_PLACES = {
    "postal": "SELECT concat('C', CAST(n_nationkey % 5 AS {text})) AS country, concat('AB', CAST(s_suppkey % 37 AS {text})) AS code, s_name AS place, CAST(s_suppkey % 180 - 90 AS DOUBLE) AS latitude, CAST(s_suppkey AS DOUBLE) AS longitude, s_suppkey AS position FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE n_nationkey % 5 < 3",
    "localities": "SELECT DISTINCT concat('C', CAST(p_partkey % 4 AS {text})) AS country, concat(p_brand, ' ', p_type) AS place, CAST(p_size AS DOUBLE) AS latitude, CAST(p_partkey % 50 AS DOUBLE) AS longitude, p_partkey AS population FROM {part}",
    "subdivisions": "SELECT concat('C', CAST(n_nationkey % 5 AS {text})) AS country, n_name AS code, CAST(n_nationkey AS DOUBLE) AS latitude, 1.5E0 AS longitude FROM {nation} WHERE n_nationkey % 2 = 0",
    "countries": "SELECT concat('C', CAST(r_regionkey AS {text})) AS country, CAST(r_regionkey AS DOUBLE) AS latitude, 9.5E0 AS longitude FROM {region} WHERE r_regionkey <> 2",
    "addresses": """SELECT c_custkey AS address_id, concat('C', CAST(c_custkey % 7 AS {text})) AS country, CASE c_custkey % 3 WHEN 0 THEN concat(' ab-', CAST(c_custkey % 60 AS {text}), 'x 9') WHEN 1 THEN 'zz9' END AS postal_code,
CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(' BRAND#', CAST(c_custkey % 30 AS {text})) WHEN 2 THEN 'nomy' WHEN 3 THEN 'o' ELSE 'nowhere' END AS locality, CASE WHEN c_custkey % 11 < 5 THEN concat(' nation_', CAST(c_nationkey AS {text})) END AS subdivision FROM {customer}""",
}
_TABLES = ("supplier", "nation", "part", "region", "customer")


@query(f"""WITH {", ".join(f"{n} AS ({q.format(text='VARCHAR', **{t: t for t in _TABLES})})" for n, q in _PLACES.items())},
a AS (SELECT *, regexp_replace(upper(trim(coalesce(postal_code, ''))), '[\\s./-]', '', 'g') AS c, lower(trim(locality)) AS l FROM addresses),
k AS (SELECT address_id, a.country, arg_max(code, length(code)) AS code FROM a JOIN (SELECT DISTINCT country, code FROM postal) p ON a.country = p.country AND length(code) >= 2 AND starts_with(c, code) GROUP BY ALL),
pc AS (SELECT address_id, arg_min(latitude, position) AS la, arg_min(longitude, position) AS lo, count(*) AS n FROM k JOIN postal USING (country, code) GROUP BY ALL),
m AS (SELECT address_id, place, latitude, longitude, population, CASE WHEN lower(place) = l THEN 0 WHEN starts_with(lower(place), l) THEN 1 ELSE 2 END AS rank FROM a JOIN localities USING (country) WHERE length(l) >= 2 AND contains(lower(place), l) AND address_id NOT IN (SELECT address_id FROM pc)),
nm AS (SELECT address_id, arg_min(latitude, (rank, -population, place)) AS la, arg_min(longitude, (rank, -population, place)) AS lo, least(count(*), 12) AS n FROM m GROUP BY ALL),
j AS (SELECT a.*, pc.la AS pla, pc.lo AS plo, pc.n AS pn, nm.la AS nla, nm.lo AS nlo, nm.n AS nn, s.latitude AS sla, s.longitude AS slo, y.latitude AS cla, y.longitude AS clo FROM a LEFT JOIN pc USING (address_id) LEFT JOIN nm USING (address_id) LEFT JOIN subdivisions s ON s.country = a.country AND upper(s.code) = upper(trim(subdivision)) LEFT JOIN countries y ON y.country = a.country)
SELECT address_id, coalesce(pla, nla, sla, cla) AS latitude, CASE WHEN pla IS NOT NULL THEN plo WHEN nla IS NOT NULL THEN nlo WHEN sla IS NOT NULL THEN slo ELSE clo END AS longitude, CASE WHEN pla IS NOT NULL THEN 'postal_area' WHEN nla IS NOT NULL THEN 'locality' WHEN sla IS NOT NULL THEN 'subdivision' WHEN cla IS NOT NULL THEN 'country' END AS precision,
       coalesce(pn, nn, 0) AS n_candidates, coalesce(trim(postal_code), '') <> '' AND country IN (SELECT country FROM postal) AND pla IS NULL AS postal_code_unknown, country IN ('C0', 'C1', 'C2', 'C3', 'C4') AS available FROM j""")
def resolved_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: adapters.table(spark, sf_dir, t) for t in _TABLES}
    made = {n: spark.sql(q.format(text="STRING", **{t: "{" + t + "}" for t in _TABLES}), **{t: d for t, d in tables.items() if "{" + t + "}" in q}) for n, q in _PLACES.items()}
    return places.resolved(made["addresses"], made["postal"], made["localities"], made["subdivisions"], made["countries"])


@query("SELECT 'C' AS country, r_regionkey AS code, 1 AS level, 'C/' || r_regionkey AS admin_path FROM region UNION ALL SELECT 'C', n_nationkey, 2, 'C/' || n_regionkey || '/' || n_nationkey FROM nation UNION ALL SELECT 'C', s_suppkey, 3, 'C/' || n_regionkey || '/' || s_nationkey || '/' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def unit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (adapters.table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    unit = lambda d, level, code, parent, name: d.select(F.lit("C").alias("country"), F.lit(level).alias("level"), F.col(code).cast("string").alias("code"), (F.col(parent).cast("string") if parent else F.lit(None).cast("string")).alias("parent_code"), F.col(name).alias("name"))
    units = unit(region, 1, "r_regionkey", None, "r_name").union(unit(nation, 2, "n_nationkey", "n_regionkey", "n_name")).union(unit(supplier, 3, "s_suppkey", "s_nationkey", "s_name"))
    return places.with_paths(units).select("country", F.col("code").cast("long").alias("code"), "level", "admin_path")
