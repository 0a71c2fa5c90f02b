"""Content-addressed WARC archive.

An archive is two Parquet tables. `payloads` has each distinct payload once, under its SHA-256; `records` has a
row per record with the exact bytes of its header block and the SHA-256 of its payload. restored() joins the two
and gives the records as a WARC file has them. Readers compute every digest anew from the stored bytes and fail
on a mismatch, so that an archive can't hand out bytes that differ from those that were written.

Cases: a null payload is stored as an empty one; a null url gives a header without WARC-Target-URI; a null id
never refers to another record and is written as an empty WARC-Record-ID; rows with equal id and payload give
equal records; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Smaller payloads are never replaced by a reference.
LEAST_BYTES = 1000
_ID = "<urn:page:"
_CRLF = "\r\n"


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row of pages (page_id, url, payload binary) to the folder path.

    Of equal payloads of at least least_bytes bytes, the record with the largest page_id is a response and the
    others are revisits that refer to it. Only digests are shuffled to find out which; payload bytes are shuffled
    once, after equal ones within a task have been merged.
    """
    payload = F.coalesce(pages["payload"], F.lit(b""))
    keyed = pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"), F.sha1(payload).alias("sha1"), F.length(payload).cast("long").alias("n_bytes"))
    leaders = keyed.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1 AND leader IS NOT NULL")
    refers = F.when(F.col("page_id") < F.col("leader"), F.col("leader"))
    header = F.concat(
        F.lit("WARC/1.1" + _CRLF),
        F.when(refers.isNull(), F.lit("WARC-Type: response" + _CRLF)).otherwise(F.lit("WARC-Type: revisit" + _CRLF)),
        F.lit("WARC-Record-ID: "), F.coalesce(F.concat(F.lit(_ID), F.col("page_id").cast("string"), F.lit(">")), F.lit("")), F.lit(_CRLF),
        F.lit(f"WARC-Date: {date}{_CRLF}"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "%0A"), F.lit(_CRLF)), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit(_CRLF),
        F.coalesce(F.concat(F.lit("WARC-Refers-To: " + _ID), refers.cast("string"), F.lit(">" + _CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + _CRLF)), F.lit("")),
        F.lit("Content-Type: text/html" + _CRLF + "Content-Length: "),
        F.when(refers.isNull(), F.col("n_bytes")).otherwise(F.lit(0)).cast("string"), F.lit(_CRLF + _CRLF),
    )
    keyed.join(leaders, "digest", "left").select(F.encode(header, "UTF-8").alias("header"), "digest").write.parquet(f"{path}/records")
    pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def _verified(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("digest")
    return stored.withColumn("payload", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("stored payload is damaged: "), "digest")).cast("binary")))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The parsed header of each record: page_id, url, record_type, refers_to, sha1, digest."""
    number = rf"^{_ID}(-?\d+)>$"
    text = F.decode("header", "UTF-8")
    identity = lambda name: F.regexp_extract(_field(F.col("text"), name), number, 1).try_cast("long")
    return spark.read.parquet(f"{path}/records").withColumn("text", text).select(
        identity("WARC-Record-ID").alias("page_id"), _field(F.col("text"), "WARC-Target-URI").alias("url"), _field(F.col("text"), "WARC-Type").alias("record_type"),
        identity("WARC-Refers-To").alias("refers_to"), F.regexp_extract(_field(F.col("text"), "WARC-Payload-Digest"), r"^sha1:([0-9a-f]{40})$", 1).alias("sha1"), "digest",
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: page_id, url, record_type, refers_to, payload_bytes and payload_digest.

    The last two are computed from the stored bytes, once for each distinct payload; the header's digest must agree.
    """
    payloads = _verified(spark, path).select("digest", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    joined = read_headers(spark, path).join(payloads, "digest", "left")
    agrees = F.col("payload_digest").eqNullSafe(F.col("sha1"))
    digest = F.when(agrees, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's header and payload disagree")).cast("string"))
    return joined.select("page_id", "url", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the whole payload of each record, revisits included."""
    return read_headers(spark, path).join(_verified(spark, path), "digest", "left").select("page_id", "payload")


def restored(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the exact bytes of each record as in a WARC file: header block, block, two line ends."""
    raw = spark.read.parquet(f"{path}/records").join(_verified(spark, path), "digest", "left")
    text = F.decode("header", "UTF-8")
    block = F.when(_field(text, "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    identity = F.regexp_extract(_field(text, "WARC-Record-ID"), rf"^{_ID}(-?\d+)>$", 1).try_cast("long")
    return raw.select(identity.alias("page_id"), F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))
