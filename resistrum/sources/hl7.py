"""HL7 v2 messages as rows: read, parsed, turned into isolates, and written.

Files are read by Spark's text source, so that they may lie wherever Spark reads, large files are split between tasks, and
a message is one row. All parsing is done by column functions; a message that can't be used stays a row with its issues.
Delimiters are those that each message declares.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resistrum.sources.shared import written

#: What a message may hold at most, and the delimiters of one that declares none.
MOST_CHARS, MOST_SEGMENTS, MOST_FIELDS, MOST_REPETITIONS, MOST_COMPONENTS, MOST_HEX = 1024 * 1024, 10_000, 512, 256, 128, 64
DELIMITERS = {"field": "|", "component": "^", "repetition": "~", "escape": "\\", "subcomponent": "&"}
#: Names by which senders call the library's own codes, LOINC and SNOMED, and the system that each kind is mapped from.
MOST_SENT = 100_000
OWN_SYSTEMS = ("WHONET", "L", "99WHONET", "99WHO")
FOREIGN_SYSTEMS = {"LOINC": ("LN", "LOINC", "HTTP://LOINC.ORG"), "SNOMED": ("SCT", "SNM", "SNOMED", "SNOMEDCT", "HTTP://SNOMED.INFO/SCT")}
MAPPED_FROM = {"organism": "SNOMED", "specimen": "SNOMED", "antibiotic": "LOINC"}
_ISSUES = "array<struct<severity: string, location: string, message: string>>"
_REASONS = "array<struct<kind: string, location: string>>"


def read_messages(spark: SparkSession, path: str, batches: bool = False) -> DataFrame:
    """raw, one row per message: a line each (segments end in \\r), or, of batches, a new one at each MSH of a file."""
    if not batches:
        return spark.read.text(path, lineSep="\n").withColumnRenamed("value", "raw").where(F.trim("raw") != "")
    files = spark.read.text(path, wholetext=True)
    return files.select(F.explode(F.split("value", r"(?:^|(?<=[\r\n]))(?=MSH)")).alias("raw")).where(F.trim("raw") != "")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), then)[0]


def _pattern(delimiter: Column) -> Column:
    # a backslash and a mark that is no letter or digit is split at without a pattern being compiled for each value
    plain = delimiter.between("0", "9") | delimiter.between("A", "Z") | delimiter.between("a", "z")
    return F.when(plain, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))).otherwise(F.concat(F.lit("\\"), delimiter))


def _split(value: Column, delimiter: Column) -> Column:
    return F.split(value, _pattern(delimiter), -1)


def _part(value: Column, delimiter: Column, k: int, most: int) -> Column:
    """The k-th part of value, none if it has fewer, and none beyond the first `most`; found without a pattern."""
    if k > most:
        return F.lit(None).cast("string")
    up_to = lambda v, n: F.call_function("substring_index", v, delimiter, F.lit(n))
    return up_to(value, 1) if k == 1 else F.when(F.length(up_to(value, k - 1)) < F.length(value), up_to(up_to(value, k), -1))


def decoded(value: Column, d: Column) -> Column:
    """value without escapes. Formatting commands go; an unknown, unclosed or malformed escape stays as it is."""
    escape = d["escape"]

    def meaning(code: Column) -> Column:
        first, whole = F.upper(F.substring(code, 1, 1)), F.concat(escape, code, escape)
        digits = F.substr(code, F.lit(2))
        is_hex = digits.rlike("^([0-9A-Fa-f]{2})*$") & (F.length(digits) <= 2 * MOST_HEX)
        out = F.when((first == "X") & is_hex, F.decode(F.unhex(digits), "ISO-8859-1"))
        for letter, name in (("F", "field"), ("S", "component"), ("T", "subcomponent"), ("R", "repetition"), ("E", "escape")):
            out = out.when(F.upper(code) == letter, d[name])
        return out.when(first.isin("H", "N", ".", "C", "M"), "").otherwise(whole)

    def joined(parts: Column) -> Column:
        last = F.size(parts) - 1
        return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, x).when(i == last, F.concat(escape, x)).otherwise(meaning(x))), "")

    return F.when(F.contains(value, escape), _let(_split(value, escape), joined)).otherwise(value)


def encoded(value: Column) -> Column:
    """value as the text of a field, with the usual delimiters escaped; empty if null."""
    out = F.coalesce(value.cast("string"), F.lit(""))
    for char, letter in (("\\", "E"), ("|", "F"), ("^", "S"), ("&", "T"), ("~", "R"), ("\r", "X0D"), ("\n", "X0A")):
        out = F.replace(out, F.lit(char), F.lit(f"\\{letter}\\"))
    return out


def field(segment: Column, position: int, d: Column) -> Column:
    """A field, by the number that the standard gives it; empty if it is not there."""
    return F.coalesce(decoded(F.trim(F.get(segment["fields"], F.lit(position))), d), F.lit(""))


def component(segment: Column, position: int, k: int, d: Column, repetition: int = 0) -> Column:
    """The k-th component of a field's repetition."""
    again = _part(F.get(segment["fields"], F.lit(position)), d["repetition"], repetition + 1, MOST_REPETITIONS)
    return F.coalesce(decoded(F.trim(_part(again, d["component"], k, MOST_COMPONENTS)), d), F.lit(""))


def subcomponent(segment: Column, position: int, k: int, sub: int, d: Column, repetition: int = 0) -> Column:
    again = F.get(F.slice(_split(F.get(segment["fields"], F.lit(position)), d["repetition"]), 1, MOST_REPETITIONS), F.lit(repetition))
    part = F.get(F.slice(_split(again, d["component"]), 1, MOST_COMPONENTS), F.lit(k - 1))
    return F.coalesce(decoded(F.trim(F.get(_split(part, d["subcomponent"]), F.lit(sub - 1))), d), F.lit(""))


def coded(segment: Column, position: int, d: Column, repetition: int = 0) -> Column:
    """A coded element: code, text and system, and the alternate ones."""
    names = ("code", "text", "system", "alternate_code", "alternate_text", "alternate_system")
    return F.struct(*[component(segment, position, k, d, repetition).alias(n) for k, n in enumerate(names, 1)])


def segments_of(message: Column, name: str) -> Column:
    return F.filter(message["segments"], lambda s: s["id"] == name)


def first_segment(message: Column, name: str) -> Column:
    return F.get(segments_of(message, name), F.lit(0))


def iso_date(value: Column) -> Column:
    """The day of a time stamp; null unless it names a day of the calendar."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd")).cast("date"))


def _issue(severity: str, location: Column | str, message: str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), (F.lit(location) if isinstance(location, str) else location).alias("location"), F.lit(message).alias("message"))


def _delimiters(header: Column) -> Column:
    own = F.substring(header, 4, 1)
    rest = F.substr(header, F.lit(5))
    marks = _let(F.position(own, rest), lambda at: F.when(at > 0, F.substr(rest, F.lit(1), at - 1)).otherwise(F.substring(rest, 1, 4)))
    given = {"field": own, **{n: F.substring(marks, k, 1) for k, n in enumerate(("component", "repetition", "escape", "subcomponent"), 1)}}
    return F.struct(*[F.when((own != "") & (given[n] != ""), given[n]).otherwise(DELIMITERS[n]).alias(n) for n in DELIMITERS])


def parsed(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """messages with the struct hl7: delimiters, segments (id, fields, index), issues, the header's values, and usable.

    fields[k] is the field that the standard numbers k. Segments keep their order, those of local names too. No message
    makes the job fail: one that is empty, too long, without MSH, with delimiters that aren't distinct or of another version
    has an error among its issues and isn't usable.
    """
    text = F.coalesce(F.col(raw), F.lit(""))
    lines = F.when(F.length(text) <= MOST_CHARS, F.filter(F.split(text, "\r\n|\r|\n"), lambda x: x.rlike(r"\S"))).otherwise(F.array().cast("array<string>"))
    d = messages.withColumn("_lines", lines).withColumn("_delimiters", _delimiters(F.coalesce(F.get("_lines", F.lit(0)), F.lit(""))))
    d = d.withColumn("_pattern", _pattern(F.col("_delimiters")["field"]))
    marks = F.array(*[F.col("_delimiters")[n] for n in DELIMITERS])
    fatal = (
        F.when(text == "", _issue("error", "message", "empty")).when(F.length(text) > MOST_CHARS, _issue("error", "message", "too long")).when(F.size("_lines") == 0, _issue("error", "message", "no segments"))
        .when(F.size("_lines") > MOST_SEGMENTS, _issue("error", "message", "too many segments")).when(~F.startswith(F.get("_lines", F.lit(0)), F.lit("MSH")), _issue("error", "message", "no MSH first"))
        .when(F.size(F.array_distinct(marks)) < 5, _issue("error", "MSH-2", "delimiters are not distinct"))
    )

    def segment(line: Column, index: Column) -> Column:
        def made(parts: Column) -> Column:
            name = F.upper(F.trim(parts[0]))
            fields = F.when(name == "MSH", F.concat(F.array(name, F.col("_delimiters")["field"]), F.slice(parts, 2, MOST_FIELDS + 1))).otherwise(parts)
            return F.struct(name.alias("id"), F.slice(fields, 1, MOST_FIELDS).alias("fields"), index.alias("index"), F.size(fields).alias("n"), name.rlike("^[A-Z][A-Z0-9]{2}$").alias("known"))

        return _let(F.split(line, F.col("_pattern"), -1), made)

    none = F.array().cast("array<struct<id: string, fields: array<string>, index: int, n: int, known: boolean>>")
    d = d.withColumn("_fatal", fatal).withColumn("_all", F.when(F.col("_fatal").isNull(), F.transform("_lines", segment)).otherwise(none))
    kept = F.transform(F.filter("_all", lambda s: s["known"]), lambda s: F.struct(s["id"].alias("id"), s["fields"].alias("fields"), s["index"].alias("index")))
    d = d.withColumn("_kept", kept).withColumn("_msh", F.get(F.filter("_kept", lambda s: s["id"] == "MSH"), F.lit(0)))
    marks, msh = F.col("_delimiters"), F.col("_msh")
    at = lambda s: F.concat(s["id"], F.lit("["), s["index"].cast("string"), F.lit("]"))
    odd = F.transform(F.filter("_all", lambda s: ~s["known"]), lambda s: _issue("warning", F.concat(F.lit("segment["), s["index"].cast("string"), F.lit("]")), "not a segment's name"))
    long = F.transform(F.filter("_all", lambda s: s["known"] & (s["n"] > MOST_FIELDS)), lambda s: _issue("warning", at(s), "too many fields"))
    version = component(msh, 12, 1, marks)
    d = d.withColumn("_version", version)
    about = F.when(F.col("_fatal").isNotNull(), F.col("_fatal")).when(msh.isNull(), _issue("error", "message", "no MSH"))
    about = about.when(F.col("_version") == "", _issue("warning", "MSH-12", "no version")).when(~F.startswith("_version", F.lit("2.")), _issue("error", "MSH-12", "another version"))
    issues = F.filter(F.concat(odd, long, F.array(about)), lambda x: x.isNotNull()).cast(_ISSUES)
    d = d.withColumn("_issues", issues)
    header = {"message_type": field(msh, 9, marks), "control_id": field(msh, 10, marks), "sending_application": component(msh, 3, 1, marks), "sending_facility": component(msh, 4, 1, marks), "processing_id": component(msh, 11, 1, marks)}
    usable = ~F.exists("_issues", lambda x: x["severity"] == "error")
    out = F.struct(marks.alias("delimiters"), F.col("_kept").alias("segments"), F.col("_issues").alias("issues"), *[v.alias(k) for k, v in header.items()], F.when(F.col("_version") == "", "2.5.1").otherwise(F.col("_version")).alias("version"), usable.alias("usable"))
    return d.withColumn("hl7", out).drop("_lines", "_delimiters", "_fatal", "_all", "_kept", "_msh", "_version", "_issues", "_pattern")


def _small(codes: DataFrame) -> DataFrame:
    """codes written once, and sent to all tasks if they are few, whatever their plan let expect."""
    kept = written(codes, "codes")
    return F.broadcast(kept) if kept.limit(MOST_SENT + 1).count() <= MOST_SENT else kept


def reconciled(elements: DataFrame, own: DataFrame, maps: DataFrame) -> DataFrame:
    """elements (kind, code, system) with the library's code: target, display, how (own or mapped) and method, or why not (reason).

    own has the library's codes (kind, code, display), maps those of other systems (kind, code, source, method), several
    sources of one being ambiguous. A code in a system that its kind isn't mapped from is not looked up.
    """
    name = F.upper(F.trim("system"))
    foreign = F.lit("")
    for system, names in FOREIGN_SYSTEMS.items():
        foreign = F.when(name.isin(*names), system).otherwise(foreign)
    wanted = F.create_map(*[F.lit(x) for pair in MAPPED_FROM.items() for x in pair])[F.col("kind")]
    inverse = maps.groupBy("kind", F.upper(F.trim("code")).alias("_code")).agg(F.min("source").alias("_source"), F.min_by("method", "source").alias("_method"), F.count_distinct("source").alias("_n"))
    named = own.select("kind", F.upper("code").alias("_code"), F.col("display").alias("_display"))
    d = elements.withColumns({"_code": F.upper(F.trim("code")), "_owned": name.isin(*OWN_SYSTEMS), "_foreign": foreign, "_blank": name == ""})
    d = d.join(named, ["kind", "_code"], "left").join(inverse, ["kind", "_code"], "left").join(named.toDF("kind", "_source", "_mapped"), ["kind", "_source"], "left")
    native = (F.col("_owned") | F.col("_blank")) & F.col("_display").isNotNull()
    agrees = ~F.col("_owned") & ((F.col("_foreign") == "") | (F.col("_foreign") == wanted)) & F.col("_n").isNotNull()
    mapped = agrees & (F.col("_n") == 1)
    reason = F.when(F.col("_code") == "", "unmapped-code").when(native | mapped, None).otherwise("unmapped-code")
    return d.select(
        *elements.columns, F.when(native, F.col("_code")).when(mapped & (F.col("_code") != ""), F.col("_source")).alias("target"), F.when(native, F.col("_display")).when(mapped, F.coalesce("_mapped", F.lit(""))).alias("display"),
        F.when(native, "own").when(mapped, "mapped").alias("how"), F.when(~native & mapped & (F.col("kind") == "antibiotic") & (F.col("_method") != "equivalent"), F.col("_method")).alias("method"), reason.alias("reason"),
    )


def _interpretation(value: Column) -> Column:
    v = F.upper(F.trim(value))
    return F.when(v.isin("S", "SUSCEPTIBLE"), "S").when(v.isin("I", "INTERMEDIATE"), "I").when(v.isin("R", "RESISTANT"), "R")


def isolates(messages: DataFrame, own: DataFrame, maps: DataFrame, lab_code: str = "") -> DataFrame:
    """One row per message of messages (message_id, hl7): the isolate it reports, and the reasons for which it must be held.

    reasons is empty for a message that can be filed. corrected tells that the sender calls it a correction. results
    maps a drug to result, measurement and method; of a drug reported twice, the later observation counts. Codes are looked up
    by joins, one row per coded element; what comes together again is one message.
    """
    d, m = F.col("hl7")["delimiters"], F.col("hl7")
    is_organism = lambda s: (F.upper(component(s, 3, 1, d)) == "ORG") | (component(s, 3, 4, d) == "11475-1") | F.contains(F.lower(component(s, 3, 2, d)), F.lit("organism"))
    flat = messages.select("message_id", "hl7", *[first_segment(m, s).alias(f"_{s.lower()}") for s in ("PID", "PV1", "SPM", "OBR")], segments_of(m, "OBX").alias("_obx"))
    flat = flat.withColumn("_organism", F.get(F.filter("_obx", is_organism), F.lit(0)))
    pid, pv1, spm, obr = (F.col(f"_{s}") for s in ("pid", "pv1", "spm", "obr"))
    first = lambda *options: F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))
    sex = F.upper(field(pid, 8, d))
    scalars = {
        "control_id": m["control_id"], "patient": first(component(pid, 3, 1, d), field(pid, 2, d)), "specimen_number": first(component(spm, 2, 1, d), component(spm, 3, 1, d), component(obr, 3, 1, d)),
        "specimen_date": F.coalesce(iso_date(field(spm, 17, d)), iso_date(component(spm, 17, 1, d)), iso_date(field(obr, 7, d))), "sex": F.when(sex.isin("M", "MALE"), "m").when(sex.isin("F", "FEMALE"), "f").otherwise(""),
        "date_of_birth": iso_date(field(pid, 7, d)), "location": component(pv1, 3, 1, d), "department": component(pv1, 3, 3, d), "location_type": F.when(F.upper(component(pv1, 2, 1, d)) == "I", "in").otherwise("out"),
        "last_name": component(pid, 5, 1, d), "first_name": component(pid, 5, 2, d), "admission_date": iso_date(field(pv1, 44, d)),
        "corrected": (F.upper(field(obr, 25, d)) == "C") | F.exists("_obx", lambda s: F.upper(field(s, 11, F.col("hl7")["delimiters"])) == "C"),
        "diagnosis_codes": F.filter(F.transform(segments_of(m, "DG1"), lambda s: component(s, 3, 1, F.col("hl7")["delimiters"])), lambda x: x != ""),
        "notes": F.array_join(F.filter(F.transform(segments_of(m, "NTE"), lambda s: field(s, 3, F.col("hl7")["delimiters"])), lambda x: x != ""), " | "),
    }
    kind = F.array_join(F.slice(F.split(m["message_type"], F.concat(F.lit("\\Q"), d["component"], F.lit("\\E"))), 1, 2), "^")
    why = lambda condition, kind_, location: F.when(condition, F.struct(F.lit(kind_).alias("kind"), F.lit(location).alias("location")))
    unusable = F.transform(F.filter(m["issues"], lambda x: x["severity"] == "error"), lambda x: F.struct(F.lit("unusable-message").alias("kind"), x["location"].alias("location")))
    own_reasons = F.concat(unusable, F.filter(F.array(
        why((kind != "") & ~F.startswith(kind, F.lit("ORU")), "unsupported-message", "MSH-9"), why(scalars["patient"] == "", "missing-field", "PID-3"), why(scalars["specimen_date"].isNull(), "missing-field", "SPM-17"),
        why(F.col("_organism").isNull(), "missing-field", "OBX"),
    ), lambda x: x.isNotNull()))
    def element(kind_: str, at: Column, location: Column, c: Column, role: str, **more: Column) -> Column:
        extra = [more.get(k, F.lit(None)).cast("string").alias(k) for k in ("result", "measurement", "unit")]
        parts = [c["alternate_code"], c["alternate_system"], c["alternate_text"]] if role == "alternate" else [c["code"], c["system"], c["text"]]
        return F.struct(F.lit(kind_).alias("kind"), at.cast("int").alias("at"), location.alias("location"), F.lit(role).alias("role"), *[p.alias(n) for p, n in zip(parts, ("code", "system", "text"), strict=True)], *extra)

    rest = F.filter("_obx", lambda s: F.col("_organism").isNull() | (s["index"] != F.col("_organism")["index"]))
    organism = F.when(F.col("_organism").isNotNull(), _let(coded(F.col("_organism"), 5, d), lambda c: element("organism", F.col("_organism")["index"], F.concat(F.lit("OBX["), F.col("_organism")["index"].cast("string"), F.lit("]-5")), c, "own")))
    specimen = F.when(component(spm, 4, 1, d) != "", _let(coded(spm, 4, d), lambda c: element("specimen", F.lit(-1), F.lit("SPM-4"), c, "own")))
    every = F.filter(F.array(organism, specimen), lambda x: x.isNotNull())
    # one pass over the messages, written as all branches below need it
    read = written(flat.select("message_id", *[v.alias(k) for k, v in scalars.items()], own_reasons.cast(_REASONS).alias("_reasons"), d.alias("_d"), F.when(m["usable"], every).alias("_every"), F.when(m["usable"], rest).alias("_rest")), "messages")
    heads = read.drop("_d", "_every", "_rest")
    # dealt by message before they are taken apart: what follows groups by message, and look-ups of small tables leave rows where they are
    dealt = read.select("message_id", "_d", "_every", "_rest").repartition("message_id")
    # observations become rows before their parts are read, as Spark compiles what it does to columns but not what it does within arrays
    seen = dealt.select("message_id", "_every", "_d", F.posexplode_outer("_rest").alias("_k", "_s"))
    s, d = F.col("_s"), F.col("_d")
    names = ("code", "text", "system", "alternate_code", "alternate_text", "alternate_system")
    seen = seen.withColumns({f"_{n}": component(s, 3, k, d) for k, n in enumerate(names, 1)} | {"_value": component(s, 5, 1, d), "_flag": component(s, 8, 1, d), "_type": field(s, 2, d), "_unit": F.lower(component(s, 6, 1, d))})
    number = (F.upper("_type") == "NM") | F.col("_value").rlike(r"^[<>=]?\s*[0-9.]+$")
    more = {"result": F.coalesce(_interpretation(F.col("_flag")), _interpretation(F.col("_value"))), "measurement": F.when(number, F.col("_value")).otherwise(""), "unit": F.col("_unit")}
    c, at = {n: F.col(f"_{n}") for n in names}, F.concat(F.lit("OBX["), s["index"].cast("string"), F.lit("]"))
    there = {"own": (c["code"] != "") | (c["alternate_code"] != ""), "alternate": c["alternate_code"] != ""}
    both = [F.when(s.isNotNull() & good, element("antibiotic", s["index"], at, c, role, **more)) for role, good in there.items()]
    # the message's own elements come with its first observation, or alone
    once = F.when(F.coalesce("_k", F.lit(0)) == 0, F.col("_every"))
    each = F.concat(F.coalesce(once, F.array().cast(read.schema["_every"].dataType)), F.filter(F.array(*both), lambda e: e.isNotNull()))
    elements = seen.select("message_id", F.explode(each).alias("e")).select("message_id", "e.*")
    found = reconciled(elements, _small(own), _small(maps))
    # of a drug's two triplets the first that is known
    best = F.min_by(F.struct("target", "display", "method", "text", "result", "measurement", "unit", "reason", "location"), F.struct(F.col("target").isNull(), F.col("role") != "own"))
    chosen = found.groupBy("message_id", "kind", "at").agg(best.alias("b")).select("message_id", "kind", "at", "b.*")
    method = F.when(F.col("method") == "mic", "MIC").when(F.col("method") == "disk", "DISK").when(F.col("method") == "gradient", "ETEST").when(F.col("unit") == "mm", "DISK").when(F.col("unit").isin("mg/l", "ug/ml"), "MIC").otherwise("")
    useless = (F.col("kind") == "antibiotic") & F.col("result").isNull() & (F.col("measurement") == "")
    held = F.when(F.col("target").isNull(), F.struct(F.lit("unmapped-code").alias("kind"), F.concat("location", F.when(F.col("kind") == "antibiotic", "-3").otherwise("")).alias("location"))).when(useless, F.struct(F.lit("unusable-value").alias("kind"), F.concat("location", F.lit("-5")).alias("location")))
    entry = F.struct(F.coalesce("result", F.lit("")).alias("result"), "measurement", method.alias("method"))
    drugs = chosen.withColumns({"_held": held, "_entry": F.when((F.col("kind") == "antibiotic") & held.isNull(), F.struct("at", "target", entry.alias("entry")))})
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    gathered = drugs.groupBy("message_id").agg(
        of("organism", "target").alias("organism"), F.max(F.when(F.col("kind") == "organism", F.coalesce(F.nullif("display", F.lit("")), "text"))).alias("organism_name"), of("specimen", "target").alias("specimen"),
        F.array_sort(F.collect_list("_entry")).alias("_drugs"), F.array_sort(F.collect_list(F.when(F.col("_held").isNotNull(), F.struct("at", F.col("_held").alias("r"))))).alias("_more"),
    )
    both = heads.join(gathered, "message_id", "left")
    last = F.filter("_drugs", lambda x: ~F.exists("_drugs", lambda y: (y["target"] == x["target"]) & (y["at"] > x["at"])))
    results = F.map_from_entries(F.transform(last, lambda x: F.struct(x["target"], x["entry"])))
    reasons = F.concat("_reasons", F.coalesce(F.transform("_more", lambda x: x["r"]), F.array().cast(_REASONS)))
    return both.select("message_id", F.lit(lab_code).alias("lab_code"), *[k for k in scalars], "organism", "organism_name", "specimen", F.when(F.col("_drugs").isNotNull(), results).alias("results"), reasons.alias("reasons"))


def as_messages(rows: DataFrame, lab: str, sender: str = "LAB", receiver: str = "CENTRAL") -> DataFrame:
    """isolate_id and raw, an observation message, for each of rows.

    rows: isolate_id, patient, specimen_number, specimen_date, specimen, organism, location, location_type, and results, a map
    of drugs to result, measurement and method; any other column is ignored. Drugs are in order; texts are escaped.
    """
    day = F.coalesce(F.date_format("specimen_date", "yyyyMMdd"), F.lit(""))
    control, number = F.concat(F.lit(f"{lab}-"), F.col("isolate_id").cast("string")), encoded(F.col("specimen_number"))

    def observed(entry: Column, k: Column) -> Column:
        v = entry["value"]
        number_ = F.coalesce(v["measurement"].cast("string").rlike(r"^[0-9]+(\.[0-9]+)?$"), F.lit(False))
        shown = F.when(number_, "NM|").otherwise("CWE|")
        label = F.when(v["result"] == "R", "Resistant").when(v["result"] == "I", "Intermediate").when(v["result"] == "S", "Susceptible").otherwise("")
        value = F.when(number_, encoded(v["measurement"])).otherwise(F.concat(encoded(v["result"]), F.lit("^"), label, F.lit("^HL70078")))
        unit = F.when(number_ & (v["method"] == "DISK"), "mm").when(number_ & v["method"].isin("MIC", "ETEST"), "mg/L").otherwise("")
        return F.concat(F.lit("OBX|"), (k + 2).cast("string"), F.lit("|"), shown, encoded(entry["key"]), F.lit("^"), encoded(entry["key"]), F.lit(" susceptibility^WHONET||"), value, F.lit("|"), unit, F.lit("||"), encoded(v["result"]), F.lit("|||F|||"), day)

    segments = [
        F.concat(F.lit(f"MSH|^~\\&|{sender}|"), encoded(F.lit(lab)), F.lit(f"|{receiver}|{receiver}|"), day, F.lit("||ORU^R01|"), encoded(control), F.lit("|P|2.5.1")),
        F.concat(F.lit("PID|1||"), encoded(F.col("patient"))),
        F.concat(F.lit("PV1|1|"), F.when(F.lower("location_type").isin("in", "inpatient", "icu"), "I").otherwise("O"), F.lit("|"), encoded(F.col("location"))),
        F.concat(F.lit("SPM|1|"), number, F.lit("|"), number, F.lit("|"), encoded(F.col("specimen")), F.lit("^"), encoded(F.col("specimen")), F.lit("^WHONET"), F.lit("|" * 13), day),
        F.concat(F.lit("OBR|1|"), number, F.lit("|"), encoded(control), F.lit("|MICRO^Microbiology^L|||"), day),
        F.concat(F.lit("OBX|1|CWE|ORG^Organism identified^L||"), encoded(F.col("organism")), F.lit("^"), encoded(F.col("organism")), F.lit("^WHONET||||||F")),
    ]
    drugs = F.transform(F.array_sort(F.map_entries("results"), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), observed)
    return rows.select("isolate_id", F.concat(F.array_join(F.concat(F.array(*segments), F.coalesce(drugs, F.array().cast("array<string>"))), "\r"), F.lit("\r")).alias("raw"))
