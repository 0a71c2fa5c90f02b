"""Surveillance tables drawn from the star schema: isolates with susceptibility results, events, results of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row per tested agent. (order_key, line, part_key, site, specimen_date) tells rows apart.
_TESTED = (
    "l.l_orderkey AS order_key", "l.l_linenumber AS line", "l.l_partkey AS part_key", "l.l_suppkey AS site",
    "concat('W/', CAST(r.r_regionkey AS STRING), '/', CAST(n.n_nationkey AS STRING)) AS admin_path", "n.n_name AS location",
    "o.o_custkey AS patient", "CAST(l.l_shipdate AS DATE) AS specimen_date", "CAST(o.o_orderdate AS DATE) AS admission_date",
    "p.p_brand AS organism", "p.p_type AS agent", "o.o_orderpriority AS specimen", "p.p_size AS size_code",
    "CASE WHEN l.l_linestatus = 'F' THEN 'in' ELSE 'out' END AS location_type",
    "CASE l.l_returnflag WHEN 'R' THEN 'R' WHEN 'A' THEN 'I' WHEN 'N' THEN 'S' END AS result", "l.l_quantity AS measurement",
)
AST = f"""
SELECT {", ".join(_TESTED)}
FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey JOIN {{part}} p ON l.l_partkey = p.p_partkey
JOIN {{supplier}} s ON l.l_suppkey = s.s_suppkey JOIN {{nation}} n ON s.s_nationkey = n.n_nationkey JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
"""
#: One row per isolate: the first result of each order and organism.
ISOLATE = """
SELECT order_key AS isolate_id, organism, min(specimen_date) AS specimen_date, min(admission_date) AS admission_date, min(patient) AS patient,
       min(site) AS site, min(specimen) AS specimen, min(location) AS location, min(location_type) AS location_type
FROM {ast} GROUP BY order_key, organism
"""
EVENT = """
SELECT event_id, CAST(ts AS DATE) AS day, ts, user_id AS patient, concat('L', CAST(user_id % 10 AS STRING)) AS location, event_type AS signal, value
FROM {events}
"""
#: A site's monthly answer to a resistance query; received on the last day it covers.
RESULT = """
SELECT site, admin_path, agent, CAST(date_trunc('month', specimen_date) AS DATE) AS period, count(*) AS denominator,
       CAST(sum(CASE WHEN result = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS numerator, max(specimen_date) AS received_at
FROM {ast} WHERE result IS NOT NULL GROUP BY site, admin_path, agent, CAST(date_trunc('month', specimen_date) AS DATE)
"""
_TABLES = ("lineitem", "orders", "part", "supplier", "nation", "region")
#: With more lines than MANY, joins are dealt by key over parts of about PART lines, so that what one task sorts and holds stays the same as tables grow.
MANY, PART = 10_000_000, 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of AST. Of many lines, the join with orders comes last, so that rows lie by order, as isolates are grouped."""
    tables = {t: table(spark, sf_dir, t) for t in _TABLES}
    n_lines = tables["lineitem"].count()
    if n_lines <= MANY:
        return spark.sql(AST, **tables)
    n = -(-n_lines // PART)
    l, o, p, s, nation, region = (tables[t].alias(a) for t, a in zip(_TABLES, ("l", "o", "p", "s", "n", "r"), strict=True))
    if tables["part"].count() > MANY:
        l, p = l.repartition(n, "l_partkey"), p.repartition(n, "p_partkey").hint("shuffle_hash")
    lines = l.join(p, F.expr("l.l_partkey = p.p_partkey")).join(s, F.expr("l.l_suppkey = s.s_suppkey"))
    lines = lines.join(nation, F.expr("s.s_nationkey = n.n_nationkey")).join(region, F.expr("n.n_regionkey = r.r_regionkey"))
    # a part of the orders is hashed: unlike a sort, that takes little for each line
    whole = lines.repartition(n, "l_orderkey").join(o.repartition(n, "o_orderkey").hint("shuffle_hash"), F.expr("l.l_orderkey = o.o_orderkey"))
    return whole.selectExpr(*_TESTED)


def isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ISOLATE, ast=ast(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENT, events=table(spark, sf_dir, "events"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RESULT, ast=ast(spark, sf_dir))


def with_views(sql: str) -> str:
    """SQL for other engines with the adapters v_ast, v_isolate, v_event and v_result before it."""
    own = AST.format(**{t: t for t in _TABLES}), ISOLATE.format(ast="v_ast"), EVENT.format(events="events"), RESULT.format(ast="v_ast")
    views = ", ".join(f"{n} AS ({q})" for n, q in zip(("v_ast", "v_isolate", "v_event", "v_result"), own, strict=True))
    sql = sql.strip()
    recursive = sql[:15].upper() == "WITH RECURSIVE "
    rest = sql[15:] if recursive else sql[5:] if sql[:5].upper() == "WITH " else None
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}" + (f", {rest}" if rest else f" {sql}")
