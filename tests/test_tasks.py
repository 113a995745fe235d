"""Sizes of tasks: partitions follow the rows, nothing large goes through the driver or one task."""

import pytest
from pyspark.sql import functions as F

from souk.operators import cascades, checkout, quality, reviews
from souk.plans import tasks
from souk.sources.fixtures import Fixture
from souk.streaming import streams


def test_partitions_follow_the_rows():
    assert [tasks.tasks_for(n, 10) for n in (0, 40, 41, 400, 4001)] == [None, None, 5, 40, 401]


def test_order_lines_keep_their_partitions_as_rows_grow(spark, monkeypatch, tmp_path):
    lines = spark.range(30_000).selectExpr("id div 4 AS l_orderkey", "id AS l_partkey", "CAST(1 AS double) AS l_quantity", "CAST(2 AS double) AS l_extendedprice")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(tasks.dealt, "__kwdefaults__", {"task_rows": 1000})
    items = Fixture(spark, str(tmp_path)).order_items().withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in items.groupBy("task").count().collect()]
    assert len(sizes) == 30 and sum(sizes) == 30_000 and max(sizes) < 2000


@pytest.mark.parametrize("task_rows", [5, 10**9])
def test_spread_changes_no_result(seed, monkeypatch, task_rows):
    monkeypatch.setattr(tasks.dealt, "__kwdefaults__", {"task_rows": task_rows})
    monkeypatch.setattr(tasks.spread, "__kwdefaults__", {"task_rows": task_rows})
    twice = seed.with_(invoices=seed.invoices.unionByName(seed.invoices))
    got = quality.check_unique(twice).filter("table_name = 'invoices'")
    assert {r["occurrences"] for r in got.collect()} == {2} and got.count() == 2 * seed.invoices.count()
    pairs = reviews.delivered_pairs(seed.with_(orders=seed.orders.withColumn("status", F.lit("delivered"))))
    assert pairs.count() == pairs.distinct().count() > 0


def test_known_row_bounds_go_with_a_changed_table(seed):
    t = seed.with_(extras={"rows": {"orders": lambda: 77, "cart": lambda: 5}})
    assert t.rows("orders") == 77 and t.rows("users") == seed.users.count()
    changed = t.with_(orders=seed.orders.limit(1))
    assert changed.rows("orders") == 1 and changed.rows("cart") == 5


def test_checkout_joins_stay_off_the_driver(spark):
    lines = spark.createDataFrame([(s, s % 7, 1 + s % 3, 5, "U", 0) for s in range(60)], "seq long, product_id long, quantity int, stock int, status string, bucket int")
    base = spark.createDataFrame([(p, 0) for p in range(7)], "product_id long, base long")
    plan = checkout._sums(lines, base)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_day_sums_are_not_made_in_the_task_that_writes_them(spark, monkeypatch):
    written = []
    monkeypatch.setattr(streams.LatestTable, "write", lambda self, rows, batch_id: written.append(rows._jdf.queryExecution().logical().toString()))
    feed = spark.createDataFrame([(1, None, 2, None)], "order_id long, created_at timestamp_ntz, quantity int, price decimal(10,2)")

    class Writer:
        def foreachBatch(self, sink):
            sink(feed, 0)

    monkeypatch.setattr(streams, "_start", lambda writer, checkpoint, trigger: None)
    streams.start_daily_sales(type("Feed", (), {"writeStream": Writer()})(), "/tmp/none", "/tmp/none")
    assert any("Repartition 1, true" in p for p in written) and not any("Repartition 1, false" in p for p in written)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def few_rows_a_task(monkeypatch):
    monkeypatch.setattr(tasks, "SMALL", 0)
    monkeypatch.setattr(tasks.tasks_for, "__defaults__", (1,))
    for f in (tasks.dealt, tasks.spread):
        monkeypatch.setattr(f, "__kwdefaults__", {"task_rows": 1})


def test_references_of_large_tables_are_looked_up_unsorted(seed, few_rows_a_task):
    lost = seed.with_(orders=seed.orders.limit(1), users=seed.users.unionByName(seed.users))
    found = quality.check_references(lost)
    assert "ShuffledHashJoin" in _plan(found)
    kept = {r["id"] for r in lost.orders.collect()}
    want = sorted((r["id"], r["order_id"]) for r in seed.order_items.collect() if r["order_id"] not in kept)
    got = found.filter("table_name = 'order_items'").collect()
    assert sorted((r["record_id"], r["missing_key"]) for r in got) == want and want
    assert quality.check_references(seed.with_(users=lost.users)).count() == 0  # a repeated parent is no orphan


def test_cascades_of_large_tables_are_looked_up_unsorted(seed, request):
    def effects(t):
        return cascades.cascade_rows(t, "users", t.users.select("id"))

    want = sorted(map(tuple, effects(seed).collect()), key=str)
    assert "ShuffledHashJoin" not in _plan(effects(seed))
    request.getfixturevalue("few_rows_a_task")
    found = effects(seed)
    assert "ShuffledHashJoin" in _plan(found)
    assert sorted(map(tuple, found.collect()), key=str) == want and want
