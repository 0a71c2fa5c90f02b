"""Large tables: joins dealt in parts by key return the same rows as their SQL, and no part holds the whole."""

import pytest
from oracle import assert_same

from resistrum.operators import screening
from resistrum.plans import registry
from resistrum.sources import adapters


@pytest.fixture
def dealt(monkeypatch):
    monkeypatch.setattr(adapters, "MANY", 1000)
    monkeypatch.setattr(adapters, "PART", 500)


@pytest.mark.parametrize("name", ["identity_lookup", "first_isolates", "repeat_isolates", "expired_isolates", "denominator_cube", "rare_results"])
def test_dealt_joins_return_the_rows_of_the_sql(spark, sf, dealt, name):
    assert_same(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)


def test_isolates_lie_in_parts_that_grow_in_number(spark, sf, dealt):
    found = adapters.isolates(spark, sf)
    assert found.rdd.getNumPartitions() >= 12  # about 6,000 lines


def test_pending_pairs_are_made_in_parts(spark, sf, monkeypatch):
    queries = spark.createDataFrame([(k, None) for k in range(20)] + [(20, [3, 3, 999]), (21, []), (20, [4])], "query_id long, targets array<long>")
    sites = spark.range(300).withColumnRenamed("id", "site")
    sent = spark.createDataFrame([(k, k + j, "sent") for k in range(21) for j in range(50)] + [(20, 3, "pending"), (None, 1, "sent")], "query_id long, site long, status string")
    monkeypatch.setattr(screening, "BLOCK", 20)
    monkeypatch.setattr(screening, "PAIRS", 500)
    found = screening.pending(queries, sent, sites)
    assert found.rdd.getNumPartitions() >= 12
    sizes = found.rdd.glom().map(len).collect()
    assert max(sizes) < sum(sizes) / 3
    assert sorted(map(tuple, found.collect())) == sorted([(k, s) for k in range(20) for s in range(300) if not k <= s < k + 50] + [(20, 3), (20, 4)])
