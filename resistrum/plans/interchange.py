"""Queries of messages, filing and payloads, and SQL that says what each returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resistrum.operators import ingest
from resistrum.plans.analysis import query
from resistrum.sources import adapters, delimited, hl7
from resistrum.sources.shared import shared_path


#: The isolates of the messages: locations with delimiters, some isolates without day, some organisms of no known code.
REPORTED = """
SELECT concat(CAST(order_key AS STRING), '-', organism) AS isolate_id, min(order_key) AS order_key, organism, min(patient) AS patient, concat(min(location), ' ^&|~x') AS location, min(location_type) AS location_type,
       CASE WHEN order_key % 11 <> 0 THEN min(specimen_date) END AS specimen_date, min(specimen) AS specimen
FROM {ast} WHERE result IS NOT NULL GROUP BY order_key, organism
"""
REPORTED_SQL = REPORTED.format(ast="v_ast").replace("AS STRING", "AS VARCHAR")
TESTED_SQL = "SELECT order_key, organism, agent, arg_max(result, (line, measurement, result)) AS result, arg_max(measurement, (line, measurement, result)) AS measurement FROM v_ast WHERE result IS NOT NULL GROUP BY 1, 2, 3"


def _exchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The isolates of all results after they were written as messages and read back."""
    ast = adapters.ast(spark, sf_dir).where("result IS NOT NULL")
    # one pass, by drug and then by isolate: the columns of REPORTED with the results of its drugs
    least = [F.min(c).alias(c) for c in ("patient", "location", "location_type", "specimen_date", "specimen")]
    tested = ast.groupBy("order_key", "organism", "agent").agg(F.max(F.struct("line", F.col("measurement").alias("m"), "result")).alias("b"), *least)
    entry = F.struct("b.result", F.col("b.m").cast("long").cast("string").alias("measurement"), F.lit("MIC").alias("method"))
    whole = tested.groupBy("order_key", "organism").agg(F.map_from_entries(F.collect_list(F.struct("agent", entry.alias("e")))).alias("results"), *least)
    number = F.concat_ws("-", F.col("order_key").cast("string"), "organism")
    rows = whole.withColumns({"isolate_id": number, "specimen_number": number, "location": F.concat("location", F.lit(" ^&|~x")), "specimen_date": F.when(F.col("order_key") % 11 != 0, F.col("specimen_date"))})
    path = shared_path(spark, "hl7")
    hl7.as_messages(rows, "LAB-1").select("raw").write.text(path)
    read = hl7.read_messages(spark, path).withColumn("message_id", F.regexp_extract("raw", r"\|ORU\^R01\|([^|]*)\|", 1))
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("code")) for kind, c in (("organism", "organism"), ("specimen", "specimen"), ("antibiotic", "agent"))])
    codes = ast.select(F.explode(kinds).alias("c")).select("c.*").distinct().where("NOT (kind = 'organism' AND code = 'Brand#13')")
    own = codes.withColumn("display", F.col("code")).withColumn("code", F.upper("code"))
    maps = spark.createDataFrame([], "kind string, code string, source string, method string")
    return hl7.isolates(hl7.parsed(read).select("message_id", "hl7"), own, maps, "LAB-1")


@query(f"""WITH r AS ({REPORTED_SQL}), t AS ({TESTED_SQL})
SELECT r.isolate_id AS specimen_number, r.patient::VARCHAR AS patient, upper(r.organism) AS organism, upper(r.specimen) AS specimen, r.specimen_date, r.location, r.location_type, upper(t.agent) AS agent, t.result, t.measurement::BIGINT::VARCHAR AS measurement, 'MIC' AS method
FROM r JOIN t USING (order_key, organism) WHERE r.specimen_date IS NOT NULL AND r.organism <> 'Brand#13'""")
def hl7_isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _exchanged(spark, sf_dir).where("size(reasons) = 0")
    flat = good.select("specimen_number", "patient", "organism", "specimen", "specimen_date", "location", "location_type", F.explode("results").alias("agent", "e"))
    return flat.select("*", "e.result", "e.measurement", "e.method").drop("e")


@query(f"""WITH r AS ({REPORTED_SQL})
SELECT 'LAB-1-' || isolate_id AS message_id, 'missing-field' AS kind, 'SPM-17' AS location FROM r WHERE specimen_date IS NULL
UNION ALL SELECT 'LAB-1-' || isolate_id, 'unmapped-code', 'OBX[5]-5' FROM r WHERE organism = 'Brand#13'""")
def hl7_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.held(_exchanged(spark, sf_dir))


@query("""WITH RECURSIVE d AS (SELECT DISTINCT order_key, line, organism, agent, result, line % 3 = 0 AS corrected, concat_ws('-', order_key, line, organism, agent, result) AS id FROM v_ast WHERE result IS NOT NULL),
m AS (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY line, id) AS k FROM d),
f AS (
  SELECT order_key, k, [organism] AS names, 1::BIGINT AS record FROM m WHERE k = 1
  UNION ALL
  SELECT order_key, m.k, CASE WHEN pos IS NULL THEN list_append(names, organism) ELSE list_concat(list_append(names[1:pos - 1], organism), names[pos + 1:]) END, coalesce(pos, len(names) + 1)
  FROM (SELECT f.order_key, f.k + 1 AS k, names, organism, CASE WHEN corrected THEN 1 ELSE list_position(names, organism)::BIGINT END AS pos FROM f JOIN m ON m.order_key = f.order_key AND m.k = f.k + 1) m
),
last AS (SELECT order_key, record, arg_max(names[record], k) AS organism FROM f GROUP BY 1, 2),
t AS (SELECT f.order_key, f.record, agent, arg_max(result, m.k) AS result FROM f JOIN m USING (order_key, k) GROUP BY 1, 2, 3)
SELECT order_key::VARCHAR AS specimen_number, record - 1 AS record, organism, agent, result FROM last JOIN t USING (order_key, record)""")
def filed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each result as a report of its own, every third one a correction."""
    d = adapters.ast(spark, sf_dir).where("result IS NOT NULL")
    results = F.create_map("agent", F.struct("result", F.lit("").alias("measurement"), F.lit("").alias("method")))
    reports = d.select(
        F.lit("LAB-1").alias("lab_code"), F.col("patient").cast("string").alias("patient"), F.col("order_key").cast("string").alias("specimen_number"), F.concat_ws("-", "order_key", "line", "organism", "agent", "result").alias("message_id"), F.col("line").cast("long").alias("seq"),
        F.col("admission_date").cast("string").alias("specimen_date"), "organism", (F.col("line") % 3 == 0).alias("corrected"), F.create_map(F.lit("location"), F.col("location")).alias("fields"), results.alias("results"),
    )
    records = ingest.filed(reports, last=True).select("specimen_number", F.col("record").cast("long").alias("record"), "organism", F.explode("results").alias("agent", "e"))
    return records.select("specimen_number", "record", "organism", "agent", "e.result")


#: What the files hold: some days and results that can't be read, some patients missing, and a state for some rows.
_FILED = """SELECT concat(CAST(order_key AS {text}), '/', CAST(line AS {text})) AS k, CASE WHEN order_key % 9 = 0 THEN '' ELSE concat('P', CAST(patient AS {text})) END AS p, organism AS o, specimen AS s, CASE WHEN order_key % 7 = 0 THEN 'soon' ELSE CAST(specimen_date AS {text}) END AS d,
concat(location, ', "', location_type, '"') AS w, CASE WHEN line % 4 = 0 THEN 'weak' WHEN line % 4 = 1 THEN 'resistant' ELSE result END AS r, CASE WHEN line % 3 = 0 THEN '' ELSE CAST(CAST(measurement AS INT) AS {text}) END AS m, CASE line % 6 WHEN 0 THEN 'Draft' WHEN 1 THEN 'odd' ELSE '' END AS t FROM {ast} WHERE result IS NOT NULL"""


@query(f"""WITH f AS (SELECT *, CASE r WHEN 'weak' THEN '' WHEN 'resistant' THEN 'R' ELSE r END AS result FROM ({_FILED.format(ast="v_ast", text="VARCHAR")})),
i AS (SELECT *, (CASE WHEN d = 'soon' THEN 1 ELSE 0 END) + (CASE WHEN r = 'weak' THEN 1 ELSE 0 END) + (CASE WHEN t = 'odd' THEN 1 ELSE 0 END) AS bad, (CASE WHEN p = '' THEN 1 ELSE 0 END) + (CASE WHEN d = 'soon' THEN 1 ELSE 0 END) + (CASE WHEN result = '' AND m = '' THEN 1 ELSE 0 END) AS lacks FROM f)
SELECT k AS specimen_number, p AS patient_id, o AS organism, CASE WHEN d = 'soon' THEN '' ELSE d END AS specimen_date, w AS location, CASE WHEN result <> '' OR m <> '' THEN result END AS result, CASE WHEN result <> '' OR m <> '' THEN m END AS measurement, CASE WHEN lacks = 0 AND t <> 'Draft' THEN 'final' ELSE 'draft' END AS record_status, (bad + lacks)::BIGINT AS n_issues FROM i""")
def delimited_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results as rows of files with a site's own headers, read back as isolates."""
    rows = spark.sql(_FILED.format(ast="{ast}", text="STRING"), ast=adapters.ast(spark, sf_dir))
    path = shared_path(spark, "csv")
    named = rows.toDF("Accession No.", "Patient No", "Organism Name", "Sample type", "Date Collected", "Ward/Clinic", "MEM_sir", "MEM MIC", "State of row")
    named.write.csv(path, header=True, escape='"', emptyValue="")
    headers, cells = delimited.read_table(spark, path)
    found = delimited.preview(headers, cells, "LAB-1", {"Accession No.": "specimen_number", "State of row": "record_status"})
    entry = F.try_element_at("results", F.lit("MEM"))
    return found.select("specimen_number", "patient_id", "organism", "specimen_date", "location", entry["result"].alias("result"), entry["measurement"].alias("measurement"), "record_status", F.size("issues").cast("long").alias("n_issues"))
