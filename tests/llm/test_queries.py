"""The numbered queries that SQL can express, and awkward rows of those without a pipeline stage."""

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from resistrum.llm import queries, urlfilter, warc
from resistrum.llm.common import new_path


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


RULES = list(queries.URL_RULES)


@pytest.mark.parametrize("most", [0, 100], ids=["joined", "cascade"])
def test_urls(spark, most):
    urls = {1: "http://EXAMPLE.com/en/x", 2: "https://www.example.com/en/", 3: "http://a.net/es/1?q", 4: "http://a.net/de/", 5: None, 6: "no scheme", 7: "http://x.org", 8: "http://com/", 9: "http://notexample.com/en/", 10: "http://a.b.net/fr/"}
    d = spark.createDataFrame([*urls.items(), (1, urls[1])], "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged(d, spark.createDataFrame(RULES, "host string, path string, verdict string"), most).collect() if r.page_id not in (5, 6))
    want = [
        (1, "example.com", "/en/x", "example.com/en/", "block"), (1, "example.com", "/en/x", "example.com/en/", "block"), (2, "www.example.com", "/en/", "www.example.com/en/", "allow"), (3, "a.net", "/es/1", "net/es/", "block"),
        (4, "a.net", "/de/", None, "allow"), (7, "x.org", "", None, "allow"), (8, "com", "/", "com/", "allow"), (9, "notexample.com", "/en/", "com/", "allow"), (10, "a.b.net", "/fr/", "net/fr/", "block"),
    ]
    assert got == want


def test_empty_urls(spark):
    d = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judged(d, spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


def test_warc_restores_every_payload(spark):
    big = "y" * 5000
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c\r\nX: 1", "small"), (4, "http://d", "small"), (5, "u", None), (None, "u", big), (7, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.encode("html", "UTF-8").alias("payload"))
    path = new_path(spark, "test-warc")
    warc.write_archive(pages, path)
    got = {r.page_id: (bytes(r.payload).decode()) for r in warc.read_payloads(spark, path).collect()}
    assert got == {i: t or "" for i, _, t in rows}
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_records(spark, path).collect()}
    assert kinds == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("response", None), 7: ("response", None)}
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    record = {r.page_id: bytes(r.record) for r in warc.restored(spark, path).collect()}
    assert record[4].endswith(b"Content-Length: 5\r\n\r\nsmall\r\n\r\n") and b"%0A" in record[3]
