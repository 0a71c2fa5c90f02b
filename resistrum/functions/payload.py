"""Identifiers in JSON payloads of any depth: keys and contents, walked as VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resistrum.sources.shared import written

#: Keys that name a person, begins of such keys, code systems whose codes are no identifiers, and patterns of contents.
BANNED = (
    "patient_id patientid patient_name patient name first_name last_name given_name family_name middle_name full_name dob date_of_birth birthdate birth_date ssn national_id passport mrn phone phone_number mobile email "
    "address street postal_code zip zipcode specimen_id accession_number barcode lab_internal_id guardian_name next_of_kin ip_address device_id geolocation gps lat lng geo_point geopoint coordinates"
).split()
STEMS = ("address", "addr_", "street", "postal", "patient_name", "guardian")
SAFE_SYSTEMS = (
    "http://snomed.info/sct", "http://loinc.org", "http://unitsofmeasure.org", "http://terminology.hl7.org/CodeSystem/v2-0074", "http://terminology.hl7.org/CodeSystem/v3-ObservationInterpretation",
    "urn:whonet:organism-code", "urn:whonet:specimen-code", "urn:whonet:antibiotic-code",
)
CONTENTS = (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"\b\d{12}\b", r"\b\+?\d{10,15}\b")
#: What a bundle of counts may hold, and keys that lead to a person.
AGGREGATE_TYPES = ("Organization", "Measure", "MeasureReport", "Observation")
LINKS = ("subject", "patient", "encounter", "specimen", "individual", "beneficiary", "telecom", "contact", "birthDate", "deceasedBoolean", "deceasedDateTime")
SIMPLE_BANNED = ("patient_name", "patient_id", "phone", "email", "address", "owner_name")


def normal_key(key: Column) -> Column:
    """A key in one spelling: camelCase, hyphens and blanks become underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(key), "(?<=[a-z0-9])(?=[A-Z])", "_")), "[- ]", "_")


def key_is_banned(key: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether a normal_key names a person, alone or by its begin."""
    found = key.isin(*BANNED, *more)
    for stem in STEMS:
        found = found | key.startswith(stem)
    return found


def content_is_banned(value: Column) -> Column:
    """Whether a text holds an address of mail or a long number, also one written with separators; dates aside."""
    joined = F.regexp_replace(F.regexp_replace(value, r"\b\d{4}-\d{2}-\d{2}\b", " "), r"[\s().\-]", "")
    found = F.lit(False)
    for text in (value, joined):
        for pattern in CONTENTS:
            found = found | text.rlike(pattern)
    return found


def walked(payloads: DataFrame, key: str, payload: str, stop: Column | None = None) -> DataFrame:
    """Every node (key, path, name, place, kind, system, value) of the JSON texts of payload, a level of all payloads at a time.

    path begins with `$`. name is an object's key, place an array's index. kind is object, array, string or other. system is what the object around a node
    has under `system`, as text. Nodes for which `stop` holds are returned, but not what is below them. There are as many rounds as
    the deepest payload has levels; the rounds' nodes are written to the shared folder. Text that isn't JSON has no nodes.
    """
    kind = F.when(F.schema_of_variant("value").startswith("OBJECT"), "object").when(F.schema_of_variant("value").startswith("ARRAY"), "array").when(F.schema_of_variant("value") == "STRING", "string").otherwise("other")
    system = F.coalesce(F.try_variant_get("value", "$.system", "string"), F.lit(""))
    none = F.lit(None).cast("string")
    level = payloads.select(F.col(key).alias("_id"), F.lit("$").alias("path"), none.alias("name"), F.lit(None).cast("int").alias("place"), F.try_parse_json(payload).alias("value")).where("value IS NOT NULL")
    level = level.select("_id", "path", "name", "place", F.lit("").alias("system"), "value", kind.alias("kind"))
    every = None
    while True:
        text = F.when(F.col("kind") == "string", F.try_variant_get("value", "$", "string")).alias("text")
        done = written(level.select("_id", "path", "name", "place", "kind", "system", text, F.when(F.col("kind").isin("object", "array"), F.to_json("value")).alias("_json")), "nodes")
        every = done if every is None else every.unionByName(done)
        open_ = done.where("_json IS NOT NULL") if stop is None else done.where(F.col("_json").isNotNull() & ~F.coalesce(stop, F.lit(False)))
        if open_.isEmpty():
            return every.drop("_json").withColumnRenamed("_id", key)
        parent = open_.select("_id", "path", "kind", F.parse_json("_json").alias("value")).withColumn("_system", system)
        child = parent.sparkSession.sql("SELECT p._id, p.path AS above, p.kind AS around, p._system AS system, c.pos, c.key AS name, c.value FROM {parent} AS p, LATERAL variant_explode(p.value) AS c", parent=parent)
        path = F.when(F.col("around") == "object", F.concat("above", F.lit("."), "name")).otherwise(F.concat("above", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = child.select("_id", path.alias("path"), F.when(F.col("around") == "object", F.col("name")).alias("name"), F.when(F.col("around") == "array", F.col("pos")).alias("place"), F.when(F.col("around") == "object", F.col("system")).otherwise("").alias("system"), "value", kind.alias("kind"))


def violations(payloads: DataFrame, key: str, payload: str, more: tuple[str, ...] = ()) -> DataFrame:
    """(key, path) of banned keys, and of banned contents with `~content` after the path.

    What is under a banned key is not looked at, nor a `code` beside a system of codes that are no identifiers.
    """
    banned = key_is_banned(normal_key(F.col("name")), more)
    safe = (normal_key(F.col("name")) == "code") & F.col("system").isin(*SAFE_SYSTEMS)
    nodes = walked(payloads, key, payload, banned | safe)
    hit = F.when(F.coalesce(banned, F.lit(False)), F.col("path")).when(~F.coalesce(safe, F.lit(False)) & (F.col("kind") == "string") & content_is_banned(F.col("text")), F.concat("path", F.lit("~content")))
    return nodes.select(key, hit.alias("path")).where("path IS NOT NULL")


def holds_key(payloads: DataFrame, key: str, payload: str, banned: tuple[str, ...] = SIMPLE_BANNED) -> DataFrame:
    """The distinct keys of payloads that hold one of `banned` as a key at any depth, whatever its case."""
    return walked(payloads, key, payload).where(F.lower("name").isin(*banned)).select(key).distinct()


def bundle_errors(bundles: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, path, error) of what keeps a bundle from being one of counts: its type, its entries' types, links to persons anywhere in them."""
    nodes = written(walked(bundles, key, payload), "bundle")
    ids = bundles.select(key).distinct()
    at = lambda path: nodes.where(F.col("path") == path)
    roots = ids.join(at("$").where("kind = 'object'").select(key), key, "left_anti").select(key, F.lit("$").alias("path"), F.lit("not an object").alias("error"))
    objects = at("$").where("kind = 'object'").select(key)

    def wanted(path: str, text: str) -> DataFrame:
        return objects.join(at(path).where(F.col("text") == text).select(key), key, "left_anti").select(key, F.lit(path).alias("path"), F.lit(f"not {text}").alias("error"))

    entries = at("$.entry").where("kind = 'array'").select(key)
    no_entries = objects.join(entries, key, "left_anti").select(key, F.lit("$.entry").alias("path"), F.lit("not an array").alias("error"))
    listed = nodes.where(F.col("path").rlike(r"^\$\.entry\[\d+\]$")).select(key, F.concat("path", F.lit(".resource")).alias("path"))
    resources = nodes.where(F.col("path").rlike(r"^\$\.entry\[\d+\]\.resource$") & (F.col("kind") == "object")).select(key, "path")
    no_resource = listed.join(resources, [key, "path"], "left_anti").select(key, "path", F.lit("not an object").alias("error"))
    types = nodes.where("name = 'resourceType'").select(key, F.regexp_replace("path", r"\.resourceType$", "").alias("path"), "text")
    other = resources.join(types, [key, "path"], "left").where(~F.coalesce(F.col("text").isin(*AGGREGATE_TYPES), F.lit(False))).select(key, "path", F.lit("type of resource").alias("error"))
    links = nodes.where(F.col("path").rlike(r"^\$\.entry\[\d+\]\.resource[.\[]") & F.col("name").isin(*LINKS)).select(key, "path", F.lit("link to a person").alias("error"))
    return roots.union(wanted("$.resourceType", "Bundle")).union(wanted("$.type", "collection")).union(no_entries).union(no_resource).union(other).union(links)
