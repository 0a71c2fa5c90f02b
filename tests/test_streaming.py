"""Streams over files, run to their end."""

import datetime as dt

from resistrum.streaming import live


def run(spark, tmp_path, batches, schema, operator):
    """The rows that the operator gives for files read one by one."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = operator(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def at(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def test_episodes(spark, tmp_path):
    rows = [[(1, "s", 1, at(0)), (2, "s", 2, at(1))], [(1, "s", 3, at(10)), (1, "s", 4, at(31))]]
    got = run(spark, tmp_path, rows, "patient long, signal string, event_id long, ts timestamp", live.episodes)
    assert sorted(r.event_id for r in got) == [1, 2, 4]


def test_repeated_deliveries_count_once(spark, tmp_path):
    rows = [[(1, "a", 5, at(0)), (1, "a", 5, at(0))], [(1, "a", 5, at(1)), (2, "a", 5, at(1))]]
    got = run(spark, tmp_path, rows, "site long, query string, value long, ts timestamp", live.once)
    assert sorted((r.site, r.query, r.value) for r in got) == [(1, "a", 5), (2, "a", 5)]
