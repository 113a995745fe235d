"""Stream = batch: results equal the batch job for any slicing and order of arrival, with a restart from a new
session on the same checkpoint between slices."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from souk.operators import audit, reports
from souk.session import scratch_dir
from souk.sources import feeds
from souk.streaming import streams
from souk.streaming.latest import LatestTable


def sliced(spark, feed, start, slices, shuffled=False):
    """Feed ``start`` slice by slice; each slice runs in a new session from the same checkpoint folder."""
    base = scratch_dir(spark, "sliced")
    key = F.xxhash64(*feed.columns) if shuffled else F.lit(0)
    cut = feed.withColumn("__slice", F.pmod(F.xxhash64(*feed.columns, key), F.lit(slices)))
    for i in range(slices):
        cut.filter(F.col("__slice") == i).drop("__slice").write.mode("append").parquet(f"{base}/source")
        own = spark.newSession()
        query = start(own.readStream.schema(feed.schema).parquet(f"{base}/source"), f"{base}/out", f"{base}/checkpoint")
        query.awaitTermination()
    return f"{base}/out"


@pytest.mark.parametrize("slices", [1, 4])
def test_rating_summary_stream_equals_batch(fx, slices):
    t = fx.tables()
    changes = streams.rating_change_feed(feeds.review_changes(fx), fx.products())
    kept = t.reviews.filter("id % 4 <> 0")
    out = sliced(fx.spark, changes, streams.start_rating_summary, slices)
    assert sorted(streams.read_rating_summary(fx.spark, out).collect()) == sorted(reports.rating_summary(t.with_(reviews=kept)).collect())


def test_product_without_a_time_keeps_its_zero_row(spark, seed):
    products = seed.products.withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    none = spark.createDataFrame([], "changed_at timestamp_ntz, op string, review_id long, product_id long, rating int, sign int")
    got = streams.stream_rating_summary(spark, streams.rating_change_feed(none, products))
    assert sorted((r["product_id"], r["review_count"]) for r in got.collect()) == [(i, 0) for i in range(1, 9)]


def test_daily_sales_stream_equals_batch_for_any_order_of_arrival(fx):
    t = fx.tables()
    live = reports.live_orders(t.orders).selectExpr("id as order_id", "created_at")
    lines = t.order_items.join(live, "order_id").select("order_id", "created_at", "quantity", "price")
    out = sliced(fx.spark, lines, streams.start_daily_sales, 3)  # slices by hash: every day arrives in all of them
    assert sorted(streams.read_daily_sales(fx.spark, out).collect()) == sorted(reports.daily_sales(t).collect())


def test_daily_sales_late_far_future_and_null_days(spark):
    day = lambda d: dt.datetime(d, 1, 5, 3)
    rows = [[(1, day(2024), 2, 1000)], [(2, day(2199), 1, 500)], [(1, day(2024), 1, 100), (3, None, 1, 700)], [(4, day(2001), 1, 300)]]
    schema = "order_id long, created_at timestamp_ntz, quantity int, price decimal(10,2)"
    base = scratch_dir(spark, "late")
    for part in rows:
        spark.createDataFrame([(o, c, q, __import__("decimal").Decimal(p) / 100) for o, c, q, p in part], schema) \
            .write.mode("append").parquet(f"{base}/source")
        streams.start_daily_sales(spark.readStream.schema(schema).parquet(f"{base}/source"), f"{base}/out", f"{base}/ckpt").awaitTermination()
    got = {r["order_date"] and r["order_date"].year: (r["total_orders"], str(r["subtotal"])) for r in streams.read_daily_sales(spark, f"{base}/out").collect()}
    assert got == {2024: (1, "21.00"), 2199: (1, "5.00"), None: (1, "7.00"), 2001: (1, "3.00")}


def test_mark_delivered_stream_any_slicing(fx):
    ev = feeds.order_status_events(fx).select("order_id", "status", "event_time", "created_at")
    results = []
    for n in (1, 3):
        out = sliced(fx.spark, ev, streams.start_mark_delivered, n)
        results.append(sorted(streams.read_mark_delivered(fx.spark, out).collect()))
    early = fx.orders().filter("status = 'cancelled' AND id % 3 = 0").count()
    assert results[0] == results[1] and early > 0 and len(results[0]) == fx.orders().count() - early


def test_delivery_query_reads_the_events_of_every_order(spark, tmp_path):
    from souk.registry import queries

    born = [dt.datetime(1992, 3, 1), dt.datetime(1996, 6, 30), dt.datetime(1996, 6, 30, 0, 0, 20), dt.datetime(2031, 5, 5, 7)]
    rows = [(i, 1, "O", "1-URGENT", b) for i, b in enumerate(born)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp_ntz") \
        .write.parquet(f"{tmp_path}/orders.parquet")
    got = queries()["stream_mark_delivered"](spark, str(tmp_path)).collect()
    assert sorted((r["order_id"], r["delivered_at"]) for r in got) == [(i, b + dt.timedelta(minutes=1)) for i, b in enumerate(born)]


def feed_by_feed(spark, start, slices, schema, read):
    """What ``read`` gives after each slice."""
    base, seen = scratch_dir(spark, "feeds"), []
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/source")
        start(spark.readStream.schema(schema).parquet(f"{base}/source"), f"{base}/out", f"{base}/ckpt").awaitTermination()
        seen.append(sorted(map(tuple, read(f"{base}/out").collect())))
    return seen


def test_nothing_is_delivered_before_its_minute_is_over(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 9) + dt.timedelta(seconds=s)
    event = lambda i, status, born, s: (i, status, at(s), at(born))
    slices = [[event(1, "pending", 0, 0), event(2, "pending", 0, 0)], [event(3, "pending", 20, 20)], [event(2, "cancelled", 0, 45)],
              [event(4, "pending", 60, 60)], [event(1, "completed", 0, 30)], [event(5, "pending", 79, 79)], [event(6, "pending", 80, 80)]]
    schema = "order_id long, status string, event_time timestamp_ntz, created_at timestamp_ntz"
    got = feed_by_feed(spark, streams.start_mark_delivered, slices, schema, lambda out: streams.read_mark_delivered(spark, out))
    one, late = (1, at(60), "pending"), (1, at(60), "completed")  # a late event corrects the status it had
    assert got == [[], [], [], [one], [late], [late], [late, (3, at(80), "pending")]]


def test_delivery_by_a_given_clock(spark):
    born = dt.datetime(2024, 1, 1, 9)
    schema = "order_id long, status string, event_time timestamp_ntz, created_at timestamp_ntz"
    wall = iter([born + dt.timedelta(seconds=20), born + dt.timedelta(seconds=70), born])
    got = feed_by_feed(spark, lambda *a: streams.start_mark_delivered(*a, clock=lambda: next(wall)),
                       [[(1, "pending", born, born)], [(2, "pending", born, born)], [(3, "pending", born, born)]], schema,
                       lambda out: streams.read_mark_delivered(spark, out))
    assert [[r[0] for r in g] for g in got] == [[], [1, 2], [1, 2, 3]]  # the clock never goes back
    quiet = feed_by_feed(spark, streams.start_mark_delivered, [[(1, "pending", born, born)]], schema,
                         lambda out: streams.read_mark_delivered(spark, out, as_of=born + dt.timedelta(minutes=1)))
    assert [r[0] for r in quiet[0]] == [1]


def _day_rows(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(o, c, q, Decimal(p) / 100) for o, c, q, p in rows],
                                 "order_id long, created_at timestamp_ntz, quantity int, price decimal(10,2)")


def test_daily_sales_files_do_not_grow_with_days_and_replays_change_nothing(spark):
    rng = random.Random(3)
    born = {o: dt.datetime(2024, 1 + o % 2, 1 + o % 28, o % 24) for o in range(400)}
    rows = [(o, born[o], rng.randrange(1, 5), rng.randrange(100, 9000)) for o in rng.choices(range(400), k=1500)]
    base, all_rows = scratch_dir(spark, "days"), []
    for at in range(0, 1500, 500):
        part = rows[at:at + 500]
        all_rows += part
        _day_rows(spark, part).coalesce(1).write.mode("append").parquet(f"{base}/source")
        stream = spark.readStream.schema(_day_rows(spark, []).schema).parquet(f"{base}/source")
        streams.start_daily_sales(stream, f"{base}/out", f"{base}/ckpt").awaitTermination()
    schema = streams.order_sums(_day_rows(spark, [])).schema
    files = [len(spark.read.schema(schema).parquet(f"{base}/out/orders/delta/b{i}").inputFiles()) for i in range(3)]
    assert max(files) <= 1  # a file a quarter and batch, whatever the days and tasks
    want = sorted(map(tuple, streams.day_differences(streams.order_images(streams.order_sums(_day_rows(spark, all_rows)), spark.createDataFrame([], schema))).collect()))
    assert sorted(map(tuple, streams.read_daily_sales(spark, f"{base}/out").collect())) == want
    seen = {}
    for o, c, q, p in all_rows:
        seen[o] = seen.get(o, 0) + q * p
    assert sum(r[2] for r in want) * 100 == sum(seen.values()) and sum(r[1] for r in want) == len(seen)
    # the last batch once more, as after a crash before its commit
    orders = LatestTable(spark, f"{base}/out/orders", ["order_quarter", "order_day", "order_id"], partition_by=["order_quarter"])
    images = streams.order_images(streams.order_sums(_day_rows(spark, rows[1000:])), orders.read(schema, 1))
    again = {tuple(r) for r in images.select("order_id", "new").collect()}
    assert again <= {tuple(r) for r in orders.read(schema).select("order_id", "subtotal").collect()}


def test_status_audit_stream_equals_batch(fx):
    ev = feeds.order_status_events(fx)
    batch = sorted(audit.status_change_audit(audit.order_status_transitions(ev), time_col="event_time").collect())
    out = sliced(fx.spark, ev, streams.start_order_status_audit, 3)
    assert sorted(fx.spark.read.parquet(out).collect()) == batch


def test_latest_table_compacts_and_survives_replayed_batches(spark):
    root = scratch_dir(spark, "latest")
    table = LatestTable(spark, root, ["k"], compact_every=3)
    rng, want = random.Random(1), {}
    for batch in range(11):
        rows = [(k, batch * 100 + k) for k in rng.sample(range(20), 6)]
        for _ in range(2):  # every batch is replayed
            table.write(spark.createDataFrame(rows, "k long, v long").coalesce(1), batch)
        want.update(rows)
    read = table.read(spark.createDataFrame([], "k long, v long").schema)
    assert {r["k"]: r["v"] for r in read.collect()} == want
    assert len(table._finished("base")) == 1 and len(table._finished("delta")) <= 3


def _guard_brute(events):
    """Each write by a plain scan of its product's stock changes."""
    out = []
    for seq, user, op, product, quantity in events:
        if op != "stock":
            past = [(s, q) for s, _, o, p, q in events if o == "stock" and p == product and s <= seq]
            stock = max(past)[1] if past else None
            reason = streams.MSG_POSITIVE if quantity <= 0 else streams.MSG_EXCEEDS if stock is None or quantity > stock else None
            out.append((seq, user, product, quantity, reason, reason is None))
    return sorted(out, key=repr)


def test_guard_judges_by_the_stock_of_the_moment_in_any_slicing(spark):
    rng = random.Random(5)
    schema = "seq long, user_id long, op string, product_id long, quantity int"
    events = [(i, None if op == "stock" else i % 9, op, 1 if rng.random() < 0.6 else rng.randrange(2, 7), rng.randrange(0, 9))
              for i, op in enumerate(rng.choices(["stock", "add", "set"], k=300))]
    events.append((streams.SPAN * 3, 1, "add", 1, 2))  # a write of a far span
    want = _guard_brute(events)
    for slices in ([events], [events[:100], events[100:200], events[200:]], [events[::-1][i::4] for i in range(4)]):
        got = feed_by_feed(spark, streams.start_cart_guard_as_of, slices, schema, lambda out: streams.read_cart_guard_as_of(spark, out))
        assert sorted(got[-1], key=repr) == want


def test_guard_learns_of_a_stock_change_late(spark):
    schema = "seq long, user_id long, op string, product_id long, quantity int"
    slices = [[(1, None, "stock", 7, 5), (10, 1, "add", 7, 4), (20, 1, "add", 7, 4)], [(15, None, "stock", 7, 3)], [(15, None, "stock", 7, 3)]]
    got = feed_by_feed(spark, streams.start_cart_guard_as_of, slices, schema, lambda out: streams.read_cart_guard_as_of(spark, out))
    assert [[r[5] for r in g] for g in got] == [[True, True], [True, False], [True, False]]


def test_audit_batches_are_written_once_and_writers_do_not_collide(spark):
    schema = "table_name string, action_type string, record_id long, details string, created_at timestamp_ntz"
    rows = lambda n, tag: spark.createDataFrame(
        [("t", "INSERT", i, tag, dt.datetime(2024, 1, 1) if i % 3 else None) for i in range(n)], schema)
    path = scratch_dir(spark, "audit")
    for writer, batch, n in [(0, 0, 40), (1, 0, 30), (0, 1, 20), (0, 1, 20), (1, 1, 0), (0, 0, 40), (511, 0, 3)]:  # two are replayed
        audit.append_audit_batch(rows(n, f"{writer}/{batch}"), path, writer, batch)
    got = audit.read_audit(spark, path).collect()
    assert len(got) == 93 == len({r["id"] for r in got}) and min(r["id"] for r in got) >= 0
    ids = {tag: [r["id"] for r in got if r["details"] == tag] for tag in ("0/0", "0/1")}
    assert max(ids["0/0"]) < min(ids["0/1"])  # a writer's batches ascend
    for writer, batch in [(512, 0), (0, 1 << 22), (-1, 0)]:
        with pytest.raises(ValueError):
            audit.append_audit_batch(rows(1, "x"), path, writer, batch)


def test_audit_streams_fill_one_table(fx):
    ev, rv = feeds.order_status_events(fx), feeds.review_changes(fx)
    spark, out = fx.spark, scratch_dir(fx.spark, "audit-table")
    streams.replay(spark, "a", rv, lambda s, _, c: streams.start_audit_table(s, "reviews", out, c))
    streams.replay(spark, "b", ev, lambda s, _, c: streams.start_audit_table(s, "orders", out, c))
    got = audit.read_audit(spark, out)
    want = audit.review_audit(rv).unionByName(audit.status_change_audit(audit.order_status_transitions(ev), time_col="event_time"))
    assert got.select("id").distinct().count() == got.count() == want.count()
    assert got.drop("id").exceptAll(want).count() == 0
