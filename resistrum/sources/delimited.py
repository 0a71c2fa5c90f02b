"""Delimited files as isolates: headers mapped to fields, drug columns gathered, cells normalised, and every doubt a row of issues.

Headers are looked at on the driver, rows never: all of them are read, mapped and judged by column functions. row tells the rows
of an import apart and ascends within a file.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from resistrum.functions import clinical

MOST_COLUMNS = 512
#: The headers under which fields come, the best first.
ALIASES = {
    "patient_id": ("patient id", "patient_id", "patient number", "patient no", "hospital number", "mrn", "uhid", "isolate id"), "specimen_number": ("specimen number", "specimen no", "accession", "accession number", "sample id"),
    "last_name": ("last name", "surname", "family name"), "first_name": ("first name", "given name"), "sex": ("sex", "gender"), "patient_type": ("patient type", "age group", "patient category"), "dob": ("dob", "date of birth", "birth date"),
    "location": ("location", "ward", "unit", "clinic"), "location_type": ("location type", "patient class", "encounter type"), "ward_type": ("ward type", "source type", "patient location", "animal location"), "department": ("department",),
    "institution": ("institution", "hospital", "facility"), "admission_date": ("admission date", "admit date", "date admitted"), "animal_species": ("animal species", "species", "host species"), "animal_type": ("animal type", "production type"),
    "specimen_reason": ("specimen reason", "reason for specimen", "sampling reason"), "serotype": ("serotype",), "reception_date": ("reception date", "received date", "date received"), "dd_test_date": ("dd test date", "disk diffusion date", "dddate"),
    "specimen_date": ("specimen date", "collection date", "date collected", "specimen collected"), "specimen_type": ("specimen type", "specimen", "sample type", "source"), "specimen_code": ("specimen code", "sample type code", "specimen type code"),
    "organism": ("organism", "organism name", "microbial species", "species"), "organism_code": ("organism code", "organism id"), "ast_method": ("ast method", "test method", "susceptibility method"), "diagnosis_code": ("diagnosis code", "icd", "icd code"),
    "diagnosis_display": ("diagnosis", "diagnosis text", "clinical diagnosis"), "notes": ("notes", "comments", "remark"),
}
#: Fields that hold days, and those that a final isolate must have.
DAYS = ("dob", "admission_date", "reception_date", "dd_test_date", "specimen_date")
REQUIRED = ("patient_id", "specimen_date", "specimen_type", "organism")
#: Headers of a drug's columns; a bare code holds results.
_DRUG = (
    (r"([A-Za-z0-9]{2,12})[ _.-]*(?:result|sir|interpretation|susceptibility)", "result"), (r"([A-Za-z0-9]{2,12})[ _.-]*(?:measurement|value|zone|mic|etest)", "measurement"),
    (r"(?:result|sir|interpretation)[ _.-]*([A-Za-z0-9]{2,12})", "result"), (r"(?:measurement|value|zone|mic)[ _.-]*([A-Za-z0-9]{2,12})", "measurement"),
)
_BARE = r"[a-z]{2,5}(?:_[a-z0-9]{1,4})?"
_ISSUES = "array<struct<severity: string, field: string, message: string>>"


def normal_header(header: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9]+", " ", header.lower()).split())


def headers_of(spark: SparkSession, path: str, delimiter: str, encoding: str) -> list[str]:
    """The headers of the files of path, blank ones numbered; refused if two are alike, or too many."""
    first = spark.read.text(path).head() if encoding == "UTF-8" else spark.read.csv(path, sep="\x00", quote="", encoding=encoding).head()
    found = next(csv.reader([(first[0] or "").lstrip("﻿")], delimiter=delimiter), []) if first else []
    found = [h.strip() or f"Column {k}" for k, h in enumerate(found, 1)]
    alike = [normal_header(h) for h in found if normal_header(h)]
    if len(set(alike)) < len(alike):
        raise ValueError(f"headers twice: {sorted({h for h in alike if alike.count(h) > 1})}")
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    return found


def read_table(spark: SparkSession, path: str, delimiter: str = ",", encoding: str | None = None) -> tuple[list[str], DataFrame]:
    """The headers, and the rows as row, too_many (more cells than headers) and c0, c1, ... (texts); rows without any text are left out.

    encoding None is UTF-8, or Latin-1 if a file isn't valid UTF-8.
    """
    if encoding is None:
        broken = not spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()
        encoding = "ISO-8859-1" if broken else "UTF-8"
    headers = headers_of(spark, path, delimiter, encoding)
    schema = StructType([StructField(f"c{k}", StringType()) for k in range(len(headers) + 1)])
    cells = spark.read.csv(path, schema=schema, sep=delimiter, header=True, enforceSchema=True, quote='"', escape='"', encoding=encoding, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    some = F.lit(False)
    for k in range(len(headers)):
        some = some | (F.trim(F.coalesce(F.col(f"c{k}"), F.lit(""))) != "")
    extra = F.col(f"c{len(headers)}").isNotNull()
    return headers, cells.withColumn("row", F.monotonically_increasing_id()).where(some | extra).select("row", extra.alias("too_many"), *[f"c{k}" for k in range(len(headers))])


def auto_mapping(headers: list[str]) -> dict[str, str]:
    """Header to field: for each field the first alias that a header is, or else that a header holds. A header taken twice goes to the later field."""
    normal, out = [normal_header(h) for h in headers], {}
    for field, aliases in ALIASES.items():
        for alias in map(normal_header, aliases):
            at = next((k for k, h in enumerate(normal) if h == alias), None)
            at = next((k for k, h in enumerate(normal) if alias in h), None) if at is None else at
            if at is not None:
                out[headers[at]] = field
                break
    return out


def drug_column(header: str) -> tuple[str, str] | None:
    """(code, 'result' or 'measurement') of a drug's column."""
    raw = header.strip()
    for pattern, part in _DRUG:
        if m := re.fullmatch(pattern, raw, re.I):
            return m[1].upper(), part
    return (raw.upper(), "result") if re.fullmatch(_BARE, normal_header(raw).replace(" ", "_")) else None


def preview(headers: list[str], cells: DataFrame, lab_code: str, mapping: dict[str, str] | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """The rows as isolates: row, lab_code, the mapped fields, results (a map to result and measurement), record_status and issues.

    mapping names fields by header, and wins over what is found by itself; `antibiotic_results.CODE.result` (or measurement) is a drug's
    column. A row that lacks a required field or any result is a draft. Cells that can't be read are issues (warnings), more
    cells than headers an error. A column whose header is both a field's and a drug's, as MRN is, is taken as both.
    """
    chosen = auto_mapping(headers) | {h: f for h, f in (mapping or {}).items() if h in headers} | {h: f for f, h in (mapping or {}).items() if h in headers and f not in headers}
    drugs: dict[str, dict[str, Column]] = {}
    text = lambda k: F.trim(F.coalesce(F.col(f"c{k}"), F.lit("")))
    fields: dict[str, Column] = {}
    issues: list[Column] = [F.when(F.col("too_many"), _issue("error", "", F.lit("more cells than headers")))]
    for k, header in enumerate(headers):
        field = chosen.get(header, "")
        own = re.fullmatch(r"antibiotic_results\.([A-Za-z0-9_-]+)\.(result|measurement)", field)
        found = (own[1].upper(), own[2]) if own else drug_column(header)
        if found:
            drugs.setdefault(found[0], {})[found[1]] = text(k)
        if not field or own:
            continue
        value: Column = text(k)
        if field in DAYS:
            day = clinical.parsed_date(text(k))
            issues.append(F.when((text(k) != "") & day.isNull(), _issue("warning", field, F.concat(F.lit("not a date: "), text(k)))))
            value = F.coalesce(day.cast("string"), F.lit(""))
        elif field == "sex":
            value = F.coalesce(clinical.sex(text(k)), F.lit(""))
        fields[field] = value
    for field, value in (defaults or {}).items():
        fields[field] = F.when(fields[field] != "", fields[field]).otherwise(value) if field in fields else F.lit(value)
    entries = []
    for code, parts in sorted(drugs.items()):
        raw, measured = parts.get("result", F.lit("")), parts.get("measurement", F.lit(""))
        result = F.coalesce(clinical.interpretation(raw), F.lit(""))
        issues.append(F.when((raw != "") & (result == ""), _issue("warning", f"{code}.result", F.concat(F.lit("not a result: "), raw))))
        entries.append(F.when((result != "") | (measured != ""), F.struct(F.lit(code).alias("key"), F.struct(result.alias("result"), measured.alias("measurement")).alias("value"))))
    none = F.array().cast("array<struct<key: string, value: struct<result: string, measurement: string>>>")
    results = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()) if entries else none)
    status = F.lower(fields.pop("record_status", F.lit("")))
    d = cells.select("row", F.lit(lab_code).alias("lab_code"), *[v.alias(f) for f, v in fields.items()], results.alias("results"), status.alias("_asked"), F.filter(F.array(*issues), lambda x: x.isNotNull()).cast(_ISSUES).alias("_issues"))
    missing = [F.when((F.col(f) == "") if f in fields else F.lit(True), F.lit(f)) for f in REQUIRED] + [F.when(F.size("results") == 0, F.lit("results"))]
    d = d.withColumn("_missing", F.filter(F.array(*missing), lambda x: x.isNotNull()))
    odd = F.when((F.col("_asked") != "") & ~F.col("_asked").isin("draft", "final"), F.array(_issue("warning", "record_status", F.concat(F.lit("not a state: "), F.col("_asked"))))).otherwise(F.array().cast(_ISSUES))
    lacks = F.transform("_missing", lambda f: F.struct(F.lit("warning").alias("severity"), f.alias("field"), F.lit("missing").alias("message")))
    final = (F.size("_missing") == 0) & (F.col("_asked") != "draft")
    return d.withColumns({"record_status": F.when(final, "final").otherwise("draft"), "issues": F.concat("_issues", odd.cast(_ISSUES), lacks.cast(_ISSUES))}).drop("_asked", "_issues", "_missing")


def _issue(severity: str, field: str, message: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field"), message.alias("message"))


def refused(rows: DataFrame, existing: DataFrame | None = None, keys: tuple[str, ...] = ("lab_code", "patient_id", "specimen_number", "organism")) -> DataFrame:
    """(row, reason) of what keeps a preview from being taken: errors among its issues, and isolates that are there already or twice in it. Identities that lack a key match nothing."""
    known = [k for k in keys if k in rows.columns]
    plain = lambda k: F.nullif(F.lower(F.trim(F.col(k).cast("string"))), F.lit(""))
    named = rows.select("row", *[plain(k).alias(f"_{k}") for k in known])
    for k in known:
        named = named.where(F.col(f"_{k}").isNotNull())
    errors = rows.where(F.exists("issues", lambda i: i["severity"] == "error")).select("row", F.lit("error").alias("reason"))
    ids = [f"_{k}" for k in known]
    first = named.groupBy(*ids).agg(F.min("row").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    twice = named.join(first, ids).where("row <> _first").select("row", F.lit("twice").alias("reason"))
    out = errors.union(twice)
    if existing is not None:
        there = existing.select(*[plain(k).alias(f"_{k}") for k in known]).distinct()
        out = out.union(named.join(there, ids, "left_semi").select("row", F.lit("known").alias("reason")))
    return out


def committed(rows: DataFrame, path: str, existing: DataFrame | None = None) -> bool:
    """Appends all rows to the Parquet table at path, or none if any is refused."""
    if not refused(rows, existing).isEmpty():
        return False
    rows.drop("issues").write.mode("append").parquet(path)
    return True
