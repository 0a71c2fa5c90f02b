"""Headers, cells and whole imports of delimited files."""

import pytest
from pyspark.sql import functions as F

from resistrum.sources import delimited


def written(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_headers_are_mapped():
    got = delimited.auto_mapping(["MRN", "Date of Birth (patient)", "Organism Name", "Ward/Unit", "collection date", "X", "Sample type code"])
    assert got == {"MRN": "patient_id", "Date of Birth (patient)": "dob", "Organism Name": "organism", "Ward/Unit": "location", "collection date": "specimen_date", "Sample type code": "specimen_code"}
    assert [delimited.drug_column(h) for h in ("MEM", "cip_nm", "MEM MIC", "CTX-result", "zone FOX", "SIR.AMK", "Organism Name", "notes!", "ABCDEF")] == [
        ("MEM", "result"), ("CIP_NM", "result"), ("MEM", "measurement"), ("CTX", "result"), ("FOX", "measurement"), ("AMK", "result"), None, ("NOTES!", "result"), None,
    ]


@pytest.mark.parametrize(("head", "wrong"), [("MRN,mrn ", "twice"), ("a b,A-B", "twice"), (",".join(f"h{k}" for k in range(513)), "columns")])
def test_headers_that_are_refused(spark, tmp_path, head, wrong):
    with pytest.raises(ValueError, match=wrong):
        delimited.read_table(spark, written(tmp_path / "a.csv", head + "\n1,2\n"))


TEXT = 'Patient no,Gender,Date Collected,Specimen,Organism,MEM_sir,MEM MIC,CIP,Row state,\n' \
       'p1,Male,03/04/2026,Blood,"E. coli, ""K12""",sensitive,0.5,R,,x\n' \
       'p2,?,soon,Urine,ECO,weak,,,final,\n,,,,,,,,,\n' \
       ' p3 ,F,2026-02-31,Blood,ECO,,,I,odd,\n' \
       'p4,f,2026-01-02,Blood,ECO,S,1,S,draft,a,b\np5\n'  # fmt: skip


def test_cells_and_issues(spark, tmp_path):
    headers, cells = delimited.read_table(spark, written(tmp_path / "a.csv", TEXT))
    assert headers[-1] == "Column 10"
    rows = {r.patient_id: r for r in delimited.preview(headers, cells, "L", {"Row state": "record_status", "sex": "Gender"}, {"ast_method": "MIC", "sex": "U"}).collect()}
    assert set(rows) == {"p1", "p2", "p3", "p4", "p5"}
    issues = {k: sorted((i.severity, i.field) for i in r.issues) for k, r in rows.items()}
    r = rows["p1"]
    assert (r.lab_code, r.sex, r.specimen_date, r.organism, r.record_status, r.ast_method, issues["p1"]) == ("L", "M", "2026-04-03", 'E. coli, "K12"', "final", "MIC", [])
    assert {k: tuple(v) for k, v in r.results.items()} == {"MEM": ("S", "0.5"), "CIP": ("R", "")}
    assert rows["p2"].record_status == "draft" and rows["p2"].sex == "U" and issues["p2"] == [("warning", "MEM.result"), ("warning", "results"), ("warning", "specimen_date"), ("warning", "specimen_date")]
    assert rows["p3"].record_status == "draft" and issues["p3"] == [("warning", "record_status"), ("warning", "specimen_date"), ("warning", "specimen_date")]
    assert rows["p4"].record_status == "draft" and issues["p4"] == [("error", "")] and len(issues["p5"]) == 4


def test_other_encodings_and_delimiters(spark, tmp_path):
    headers, cells = delimited.read_table(spark, written(tmp_path / "a.tsv", "MRN\tOrganism\tNöte\nJosé\tStraße\tx\n", "latin-1"), "\t")
    assert headers == ["MRN", "Organism", "Nöte"] and cells.select("c0", "c1").first()[:] == ("José", "Straße")
    headers, cells = delimited.read_table(spark, written(tmp_path / "b.csv", "﻿MRN,Organism\nJosé,\U0001f600\n"))
    assert headers == ["MRN", "Organism"] and cells.first().c1 == "\U0001f600"
    headers, cells = delimited.read_table(spark, written(tmp_path / "c.csv", "MRN,Organism\n"))
    assert cells.count() == 0 and delimited.preview(headers, cells, "L").count() == 0


def test_an_import_is_taken_whole_or_not_at_all(spark, tmp_path):
    rows = lambda text: delimited.preview(*delimited.read_table(spark, written(tmp_path / f"{abs(hash(text))}.csv", text)), "L")
    head, path = "MRN,Accession,Organism,MEM\n", str(tmp_path / "table")
    assert delimited.committed(rows(head + "p1,1,ECO,S\np2,2,ECO,R\n,3,ECO,S\n,3,ECO,S\n"), path)
    table = spark.read.parquet(path)
    assert table.count() == 4
    again = rows(head + "p9,9,ECO,S\n P1 ,1,eco,R\n")
    assert [r.reason for r in delimited.refused(again, table).collect()] == ["known"] and not delimited.committed(again, path, table)
    assert [r.reason for r in delimited.refused(rows(head + "p8,1,ECO,S\np8,1,ECO,R\np8,1,KPN,R\n")).collect()] == ["twice"]
    assert not delimited.committed(rows(head + "p7,1,ECO,S,more\n"), path) and spark.read.parquet(path).count() == 4
    assert delimited.refused(rows(head).withColumn("_first", F.lit(1)), table).count() == 0
