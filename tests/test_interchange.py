"""Messages, filing of reports and their stream, on awkward input."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from resistrum.operators import ingest
from resistrum.sources import hl7

HEAD = r"MSH|^~\&|LIS|CITY|X|LAB01|20260114093000||ORU^R01|M1|P|2.5.1"
ORG = "OBX|1|CWE|ORG^Organism identified^L||KPN^Klebsiella pneumoniae^WHONET||||||F"
GOOD = [HEAD, "PID|1||P-1001||Devi^Anita||19850302|F", "PV1|1|I|ICU-2^^Critical Care", "SPM|1|SP-77|SP-77|BLD^Blood^WHONET|||||||||||||20260114", ORG, "OBX|2|NM|MEM^Meropenem^WHONET||8|mg/L||R|||F", "OBX|3|NM|CIP^Cipro^WHONET||22|mm||S|||F"]
OWN = [("organism", "KPN", "Klebsiella"), ("organism", "ECO", "Escherichia"), ("specimen", "BLD", "Blood"), ("antibiotic", "MEM", "Meropenem"), ("antibiotic", "CIP", "Cipro")]
MAPS = [("organism", "112283007", "ECO", "equivalent"), ("antibiotic", "18932-4", "MEM", "mic"), ("antibiotic", "1-1", "MEM", "mic"), ("antibiotic", "1-1", "CIP", "disk"), ("specimen", "119297000", "BLD", "equivalent")]


def parsed(spark, *raws):
    return hl7.parsed(spark.createDataFrame([(str(k), r) for k, r in enumerate(raws)], "message_id string, raw string"))


def isolates(spark, *raws):
    own, maps = spark.createDataFrame(OWN, "kind string, code string, display string"), spark.createDataFrame(MAPS, "kind string, code string, source string, method string")
    return {r.message_id: r for r in hl7.isolates(parsed(spark, *raws), own, maps, "LAB01").collect()}


@pytest.mark.parametrize(("raw", "want"), [
    (r"a\F\b\S\c\T\d\R\e\E\f", r"a|b^c&d~e\f"), (r"\X4142\x", "ABx"), (r"\XZZ\x", r"\XZZ\x"), (r"\X4\x", r"\X4\x"), (r"a\.br\b\H\c\N\d", "abcd"), (r"\Zown\x", r"\Zown\x"), (r"open\F", r"open\F"),
    (r"\\x", r"\\x"), ("plain", "plain"), ("", ""), (r"\f\ \Fx\ ", r"| \Fx\ "), ("\\X" + "41" * 65 + "\\", "\\X" + "41" * 65 + "\\"),
])
def test_escapes(spark, raw, want):
    d = F.struct(*[F.lit(v).alias(k) for k, v in hl7.DELIMITERS.items()])
    assert spark.createDataFrame([(raw,)], "x string").select(hl7.decoded(F.col("x"), d)).first()[0] == want


def test_encoded_texts_come_back(spark):
    texts = ["a|b^c&d~e\\f", "\r\n", "\\X41\\", "", "é\U0001f600"]
    d = F.struct(*[F.lit(v).alias(k) for k, v in hl7.DELIMITERS.items()])
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(hl7.encoded(F.col("x")).alias("e"), hl7.decoded(hl7.encoded(F.col("x")), d).alias("y")).collect()
    assert [r.y for r in rows] == texts and not any(set("|^&~\r\n") & set(r.e) for r in rows)


def test_messages_that_cannot_be_used(spark):
    raws = [None, "", " \r\n", "PID|1||P", "M" * (hl7.MOST_CHARS + 1), "MSH|^^^^|LIS|C|A|L|2026||ORU^R01|X|P|2.5.1", HEAD.replace("2.5.1", "3.0"), "MSHS|a", "\r".join([HEAD] + ["NTE|1"] * hl7.MOST_SEGMENTS)]
    got = [r.hl7 for r in parsed(spark, *raws).orderBy(F.col("message_id").cast("int")).collect()]
    assert [[i.message for i in x.issues if i.severity == "error"] for x in got] == [
        ["empty"], ["empty"], ["no segments"], ["no MSH first"], ["too long"], ["delimiters are not distinct"], ["another version"], ["no MSH"], ["too many segments"],
    ]
    assert not any(x.usable for x in got)


def test_own_delimiters_odd_segments_and_repetitions(spark):
    own = "MSH#*!/%#LIS*x#C#A#L#2026##ORU*R01#7#P#2.5.1\rPID#1##A!B*C%D/F/E\r?? bad\rZXX#1\r\rOBX#" + "#".join("x" for _ in range(600))
    m = parsed(spark, own).select("hl7.*").first()
    assert (m.message_type, m.control_id, m.sending_application, m.usable) == ("ORU*R01", "7", "LIS", True)
    assert [s.id for s in m.segments] == ["MSH", "PID", "ZXX", "OBX"] and [(i.severity, i.location) for i in m.issues] == [("warning", "segment[2]"), ("warning", "OBX[4]")]
    assert len(m.segments[3].fields) == hl7.MOST_FIELDS
    pid, d = hl7.first_segment(F.col("hl7"), "PID"), F.col("hl7.delimiters")
    row = parsed(spark, own).select(hl7.component(pid, 3, 1, d), hl7.component(pid, 3, 2, d, 1), hl7.subcomponent(pid, 3, 2, 1, d, 1), hl7.subcomponent(pid, 3, 2, 2, d, 1), hl7.component(pid, 9, 1, d), hl7.field(hl7.first_segment(F.col("hl7"), "ABC"), 1, d)).first()
    assert tuple(row) == ("A", "C%D#E", "C", "D#E", "", "")


def test_isolate_of_a_message(spark):
    r = isolates(spark, "\r".join(GOOD), "\n".join([GOOD[0], GOOD[3], "ZLC|1|local", *GOOD[1:2], *GOOD[4:]]))
    for x in r.values():
        assert (x.reasons, x.patient, x.organism, str(x.specimen_date), x.specimen, x.sex, x.corrected) == ([], "P-1001", "KPN", "2026-01-14", "BLD", "f", False)
        assert {k: tuple(v) for k, v in x.results.items()} == {"MEM": ("R", "8", "MIC"), "CIP": ("S", "22", "DISK")}
    assert (r["0"].location, r["0"].department, r["0"].location_type, r["1"].location_type) == ("ICU-2", "Critical Care", "in", "out")


def with_(**changes):
    return "\r".join(changes.get(s.split("|")[0] + s.split("|")[1] if s.startswith("OBX") else s.split("|")[0], s) for s in GOOD)


def test_codes_and_reasons(spark):
    r = isolates(
        spark, with_(OBX1="OBX|1|CWE|ORG^o^L||112283007^E^SCT"), with_(OBX1="OBX|1|CWE|ORG^o^L||XYZ^E^WHONET"), with_(OBX1="OBX|1|CWE|ORG^o^L||18932-4^E^LN"), with_(OBX2="OBX|2|ST|M9^M^99LOCAL^18932-4^M^LN||>16|||R"),
        with_(OBX2="OBX|2|ST|1-1^M^LN||x|||R"), with_(OBX2="OBX|2|ST|MEM^M^L||SDD|||"), with_(SPM="SPM|1|S|S|BLD^B^L|||||||||||||202601"), with_(PID="PID|1|OLD"), with_(OBX1="NTE|1||none"), with_(MSH=HEAD.replace("ORU^R01", "ADT^A01")),
        with_(OBX1="OBX|1|CWE|ORG^o^L||112283007^E^"), with_(OBX2="OBX|2|CWE|MEM^M^L||R^Resistant^HL70078||||||C"), with_(OBX3="OBX|3|NM|MEM^M^L||4|||S"), with_(PID="PID|1||"),
    )
    reasons = {k: sorted((x.kind, x.location) for x in v.reasons) for k, v in r.items()}
    assert (r["0"].organism, r["0"].organism_name, reasons["0"]) == ("ECO", "Escherichia", [])
    assert reasons["1"] == reasons["2"] == [("unmapped-code", "OBX[4]-5")]
    assert {k: tuple(v) for k, v in r["3"].results.items()}["MEM"] == ("R", ">16", "MIC") and reasons["3"] == []
    assert reasons["4"] == [("unmapped-code", "OBX[5]-3")] and reasons["5"] == [("unusable-value", "OBX[5]-5")] and reasons["6"] == [("missing-field", "SPM-17")]
    assert r["7"].patient == "OLD" and reasons["8"] == [("missing-field", "OBX")] and reasons["9"] == [("unsupported-message", "MSH-9")]
    assert r["10"].organism == "ECO" and r["11"].corrected and r["11"].results["MEM"].result == "R" and r["12"].results["MEM"].result == "S" and reasons["13"] == [("missing-field", "PID-3")]


def test_parts_are_found_without_patterns(spark):
    """Parts of a field are those that a split gives, and reading a component compiles no pattern unless it has escapes."""
    values = ["", "a", "^", "a^b", "^^c", "a^^b^", "é^😀^x", None]
    d = F.struct(*[F.lit(v).alias(k) for k, v in hl7.DELIMITERS.items()])
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    got = rows.select(*[hl7._part(F.col("x"), d["component"], k, 3).alias(f"p{k}") for k in (1, 2, 3, 4)])
    want = [None if v is None or k > 3 or k > len(v.split("^")) else v.split("^")[k - 1] for v in values for k in (1, 2, 3, 4)]
    assert [x for r in got.collect() for x in r] == want and "split(" not in got._jdf.queryExecution().analyzed().toString()


def test_batches_of_messages(spark, tmp_path):
    (tmp_path / "a.hl7").write_bytes(("\r".join(GOOD) + "\r" + "\r\n".join(GOOD[:3]) + "\r\n").encode())
    got = hl7.parsed(hl7.read_messages(spark, str(tmp_path), batches=True)).select("hl7.usable", F.size("hl7.segments")).collect()
    assert sorted(map(tuple, got)) == [(True, 3), (True, 7)]


def test_no_python_in_the_parser(spark):
    plan = parsed(spark, "x")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


REPORT = "message_id string, seq long, lab_code string, patient string, specimen_number string, specimen_date string, organism string, corrected boolean, fields map<string, string>, results map<string, struct<result: string, measurement: string, method: string>>"
REPORTS = [
    ("a", 1, "L", "p", "s", "2026-01-01", "KPN", False, {"location": "ICU"}, {"MEM": ("R", "8", "MIC")}),
    ("b", 2, "L", "p", "s", "2026-01-01", "ECO", False, {"location": ""}, {"CIP": ("S", "", "")}),
    ("c", 3, "L", "p", "s", "2026-01-01", "PAE", True, {"location": "W2", "notes": None}, {"MEM": ("S", "1", "MIC"), "GEN": None}),
    ("d", 4, "L", "p", "s", "2026-01-01", "PAE", False, {}, {"MEM": ("S", "1", "DISK"), "CIP": ("I", "", "")}),
    ("e", 5, "L", "p", "s", "2026-01-02", "XXX", True, {}, None), ("f", 1, "L", "p", "t", None, None, None, None, None), ("f", 1, "L", "p", None, None, "KPN", True, {}, {}),
]


def rows_of(df):
    plain = lambda x: tuple(sorted((k, None if v is None else tuple(v) if not isinstance(v, str) else v) for k, v in (x or {}).items()))
    return sorted((str(r.specimen_number), r.record, r.message_id, r.status, tuple(r.changes), r.newest, r.organism, r.specimen_date, plain(r.fields), plain(r.results)) for r in df.collect())


def test_reports_are_folded_in_order(spark):
    d = spark.createDataFrame(REPORTS + REPORTS[:2], REPORT).withColumn("record", F.lit("clash"))
    got = rows_of(ingest.filed(d.repartition(3)))
    assert [(r[2], r[1], r[3], r[4]) for r in got if r[0] == "s"] == [
        ("a", 0, "created", ()), ("c", 0, "merged", ("organism: KPN -> PAE", "location: ICU -> W2", "MEM: R -> S")), ("d", 0, "merged", ("CIP: I",)), ("b", 1, "created", ()), ("e", 2, "created", ()),
    ]
    newest = {r[1]: r for r in got if r[0] == "s" and r[5]}
    assert newest[0][6] == "PAE" and newest[0][9] == (("CIP", ("I", "", "")), ("MEM", ("S", "1", "MIC"))) and newest[1][6] == "ECO" and newest[1][8] == ()
    assert len(got) == 7 and ingest.filed(d.limit(0)).count() == 0


def test_reports_are_folded_from_whole_columns(spark):
    """Rows of filed are those that folded makes of each specimen, with awkward texts and fields, over the ends of batches; `last` returns the newest."""
    rng = random.Random(8)
    text = lambda *some: rng.choice([*some, "", "  ", None])
    reports = []
    for k in range(400):
        fields = rng.choice([None, {}, {"location": text("A", " B\u2003", "C")}, {"notes": text("x"), "location": text("B")}, {"organism": text("ECO", "PAE")}, {"specimen_date": text("2026-01-01", "2026-01-02"), "notes": text("y")}])
        entry = lambda: rng.choice([None, (text("R", "S", " S"), text("1", "2"), text("MIC", "DISK"))])
        results = rng.choice([None, {}, {"MEM": entry()}, {"MEM": entry(), "CIP": entry()}, {"GEN": entry(), "MEM": entry()}])
        reports.append((f"m{k}", rng.randrange(9), "L", "p", text(*"abcdefgh"), text("2026-01-01", "2026-01-02"), text("KPN", "ECO", "PAE", " KPN"), rng.choice([True, False, None]), fields, results))
    d = spark.createDataFrame(reports, REPORT)
    names = [f.name for f in d.schema]
    by = {}
    for values in d.collect():  # maps in Spark's order
        r = dict(zip(names, values, strict=True))
        shaped = {k: dict(zip(("result", "measurement", "method"), v, strict=True)) for k, v in (r["results"] or {}).items() if v is not None}
        by.setdefault(r["specimen_number"], []).append(r | {"corrected": bool(r["corrected"]), "fields": r["fields"] or {}, "results": shaped})
    plain = lambda x: sorted((k, v if isinstance(v, str) else tuple(v.values() if isinstance(v, dict) else v)) for k, v in x.items())
    row = lambda number, r: (str(number), r["message_id"], r["seq"], r["record"], r["status"], tuple(r["changes"]), r["newest"], r["organism"], r["specimen_date"], plain(r["fields"]), plain(r["results"]))
    want = [(x["newest"], repr(row(number, x))) for number, own in by.items() for x in ingest.folded(own)]
    assert "specimen_date: 2026-01-01 -> 2026-01-02" in str(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for last in (False, True):
            found = ingest.filed(d.repartition(5), last).collect()
            assert sorted(repr(row(r.specimen_number, r.asDict())) for r in found) == sorted(x for newest, x in want if newest or not last)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = ingest.filed(d)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_stream_of_corrections_ends_as_the_batch(spark, tmp_path):
    rng = random.Random(3)
    reports = [(f"m{k}", k, "L", f"p{k % 3}", f"s{k % 5}", "2026-01-01", rng.choice(["KPN", "ECO", "PAE"]), rng.random() < 0.3, {"location": rng.choice(["", "A", "B"])}, {rng.choice(["MEM", "CIP"]): (rng.choice("RIS"), "", "")}) for k in range(60)]
    want = rows_of(ingest.filed(spark.createDataFrame(reports, REPORT)))
    schema = f"{REPORT}, sent_at timestamp"
    mixed = reports + reports[::7]
    rng.shuffle(mixed)
    source, seen = tmp_path / "in", {}
    source.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def keep(batch, _):
        frame = batch.toPandas()
        for key, rows in frame.groupby(ingest.SPECIMEN):
            seen[key] = rows

    try:
        for part in range(3):  # each start goes on from the checkpoint
            piece = [(*r, datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=r[1])) for r in mixed[part::3]]
            spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(str(source))
            stream = ingest.corrected_stream(spark.readStream.schema(schema).parquet(str(source))).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            stream.awaitTermination(240)
            assert stream.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r["message_id"], r["record"], r["status"], tuple(r["changes"]), bool(r["newest"]), r["organism"]) for f in seen.values() for r in f.to_dict("records"))
    assert got == sorted((w[2], w[1], w[3], w[4], w[5], w[6]) for w in want)
