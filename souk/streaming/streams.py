"""Structured Streaming forms of the reference's triggers and scheduled event.

``start_*`` functions attach to any streaming DataFrame and take an output folder and a checkpoint folder of the caller's
choice, so a job resumes after its process ends; ``read_*`` functions give the current result. No stream drops a late
row, a row without a time or an old key: keyed results are upserted (``LatestTable``), the others
are stateless. Per-key state (one row a product or order) is kept for good, as the triggers' tables are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from souk.functions.money import average_rating, money, sum_of_lines, with_totals
from souk.operators.audit import append_audit_batch, product_insert_audit, read_audit, review_audit, status_change_audit
from souk.plans.asof import values_as_of
from souk.plans.tasks import tasks_for
from souk.session import scratch_dir
from souk.streaming.latest import LatestTable
from souk.streaming.replay import replay

# Trigger messages.
MSG_POSITIVE = "Cart quantity must be positive"
MSG_EXCEEDS = "Cart quantity exceeds available stock"


def _start(writer: DataStreamWriter, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _append(rows: DataFrame, out: str, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return _start(rows.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint, trigger)


# ------------------------------------------------------------------ X1
_RATING_KEYS = ["product_id"]


def rating_summary_changes(stream: DataFrame) -> DataFrame:
    """Signed review changes (+1 insert, -1 delete, 0 new product) to running per-product totals."""
    return stream.groupBy("product_id").agg(
        F.sum("sign").cast("long").alias("review_count"),
        F.sum(F.col("sign") * F.coalesce(F.col("rating"), F.lit(0))).cast("long").alias("rating_sum"))


def start_rating_summary(changes: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """X1 / X1b. Keep per-product totals current from review inserts, deletes and new products."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        LatestTable(batch.sparkSession, out, _RATING_KEYS).write(batch, batch_id)

    totals = rating_summary_changes(changes)
    return _start(totals.writeStream.outputMode("update").foreachBatch(sink), checkpoint, trigger)


def read_rating_summary(spark: SparkSession, out: str) -> DataFrame:
    schema = spark.range(0).selectExpr("id AS product_id", "id AS review_count", "id AS rating_sum").schema
    latest = LatestTable(spark, out, _RATING_KEYS).read(schema)
    return latest.select("product_id", "review_count", average_rating("rating_sum", "review_count").alias("average_rating"))


def rating_change_feed(review_changes: DataFrame, products: DataFrame) -> DataFrame:
    """Review changes plus a zero row per product (the product-insert trigger)."""
    prods = products.select(F.col("created_at").alias("changed_at"), F.lit("PRODUCT").alias("op"),
                            F.lit(None).cast("bigint").alias("review_id"), F.col("id").alias("product_id"),
                            F.lit(None).cast("int").alias("rating"), F.lit(0).alias("sign"))
    return review_changes.unionByName(prods)


def stream_rating_summary(spark: SparkSession, changes: DataFrame) -> DataFrame:
    return read_rating_summary(spark, replay(spark, "rating-summary", changes, start_rating_summary))


# ------------------------------------------------------------------ X2
def start_order_status_audit(changes: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """X2. 'old -> new' audit rows; a change row carries both images (old_status, status), as the trigger's does: no state."""
    pairs = changes.select("order_id", "old_status", F.col("status").alias("new_status"), "event_time")
    return _append(status_change_audit(pairs, time_col="event_time"), out, checkpoint, trigger)


def stream_order_status_audit(spark: SparkSession, events: DataFrame) -> DataFrame:
    return spark.read.parquet(replay(spark, "status-audit", events, start_order_status_audit))


def start_review_audit(changes: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """X2 (reviews). Insert and delete audit rows, appended as changes arrive."""
    return _append(review_audit(changes), out, checkpoint, trigger)


def stream_review_audit(spark: SparkSession, changes: DataFrame) -> DataFrame:
    return spark.read.parquet(replay(spark, "review-audit", changes, start_review_audit))


#: Numbers of the writers of one audit table, a stream each.
AUDIT_WRITERS = {"reviews": 0, "products": 1, "orders": 2}


def order_audit(changes: DataFrame) -> DataFrame:
    """Status audit rows of order changes that carry both images (old_status, status)."""
    return status_change_audit(changes.select("order_id", "old_status", F.col("status").alias("new_status"), "event_time"), time_col="event_time")


_AUDIT_ROWS = {"reviews": review_audit, "products": product_insert_audit, "orders": order_audit}


def start_audit_table(changes: DataFrame, source: str, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """X2 with ids. Audit rows of ``source`` (reviews, products or orders) appended to the audit table at ``out``.

    One table takes the streams of all sources at once: each is a writer of its own, and a replayed batch replaces its own rows."""
    rows, writer = _AUDIT_ROWS[source], AUDIT_WRITERS[source]

    def sink(batch: DataFrame, batch_id: int) -> None:
        append_audit_batch(rows(batch), out, writer, batch_id)

    return _start(changes.writeStream.foreachBatch(sink), checkpoint, trigger)


def stream_audit_table(spark: SparkSession, feeds: dict[str, DataFrame]) -> DataFrame:
    """Rows of the audit table that a stream of each source has filled, without the ids."""
    out = scratch_dir(spark, "audit-table")
    for source, feed in feeds.items():
        replay(spark, f"audit-{source}", feed, lambda stream, _, ckpt, s=source: start_audit_table(stream, s, out, ckpt))
    return read_audit(spark, out).drop("id")


# ------------------------------------------------------------------ X3
_DELIVERY_KEYS = ["order_id", "created_at"]


def _due() -> Column:
    return F.col("created_at") + F.expr("INTERVAL 1 MINUTE")  # fixed value: the scheduler's delay


def status_when_due(stream: DataFrame) -> DataFrame:
    """Each order's status one minute after creation, and the latest time its events tell (``seen``).

    Later events cannot change the status, a late earlier one corrects it."""
    last = F.max(F.when(F.col("event_time") <= _due(), F.struct("event_time", "status")))
    return stream.groupBy("order_id", "created_at").agg(last.alias("last"), F.max("event_time").alias("seen")) \
        .select("order_id", "created_at", F.col("last.status").alias("previous_status"), "seen")


def _wall(moment: dt.datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def start_mark_delivered(events: DataFrame, out: str, checkpoint: str, trigger: dict | None = None,
                         clock: Callable[[], dt.datetime] | None = None) -> StreamingQuery:
    """X3. The once-a-minute delivery event.

    An order is delivered when the clock has passed its creation by a minute, not before. The clock is the latest event
    time the stream has brought, or what ``clock()``, which must not go back, gives when a batch runs (the wall clock, say).
    Late events are upserted: an order cancelled within its minute is not delivered, whenever that is learnt."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        if clock:
            batch = batch.withColumn("seen", _wall(clock()))
        LatestTable(batch.sparkSession, out, _DELIVERY_KEYS).write(batch, batch_id)

    return _start(status_when_due(events).writeStream.outputMode("update").foreachBatch(sink), checkpoint, trigger)


def read_mark_delivered(spark: SparkSession, out: str, as_of: dt.datetime | None = None) -> DataFrame:
    """Deliveries up to the stream's clock, or as seen at ``as_of`` where that is later (a quiet stream brings no new time)."""
    time = "CAST(NULL AS timestamp_ntz)"
    schema = spark.range(0).selectExpr("id AS order_id", f"{time} AS created_at", "'' AS previous_status", f"{time} AS seen").schema
    orders = LatestTable(spark, out, _DELIVERY_KEYS).read(schema)
    now = orders.agg(F.max("seen")).scalar()
    if as_of is not None:
        now = F.greatest(now, _wall(as_of))
    return orders.filter(F.col("previous_status").isin("pending", "completed") & (_due() <= now)).select(
        "order_id", _due().alias("delivered_at"), "previous_status")


def stream_mark_delivered(spark: SparkSession, events: DataFrame) -> DataFrame:
    feed = events.select("order_id", "status", "event_time", "created_at")
    return read_mark_delivered(spark, replay(spark, "mark-delivered", feed, start_mark_delivered))


# ------------------------------------------------------------------ X4
def cart_guard(stream: DataFrame, products: DataFrame) -> DataFrame:
    """Cart write guard: positive quantity, product known, quantity within stock."""
    stock = products.select(F.col("id").alias("product_id"), "stock")
    j = stream.join(stock, "product_id", "left")
    reason = (F.when(F.col("quantity") <= 0, F.lit(MSG_POSITIVE))
               .when(F.col("stock").isNull() | (F.col("quantity") > F.col("stock")), F.lit(MSG_EXCEEDS)))
    return j.select("seq", "user_id", "product_id", "quantity", reason.alias("reason"),
                    reason.isNull().alias("accepted"))


def start_cart_guard(writes: DataFrame, products: DataFrame, out: str, checkpoint: str,
                     trigger: dict | None = None) -> StreamingQuery:
    """X4. Stream-static join of attempted cart writes (add / set) against product stock."""
    return _append(cart_guard(writes.filter(F.col("op").isin("add", "set")), products), out, checkpoint, trigger)


def stream_cart_guard(spark: SparkSession, cart_feed: DataFrame, products: DataFrame) -> DataFrame:
    return spark.read.parquet(replay(spark, "cart-guard", cart_feed,
                                     lambda stream, out, ckpt: start_cart_guard(stream, products, out, ckpt)))


_VERSION_KEYS, _VERDICT_KEYS = ["product_id", "seq"], ["span", "seq"]
#: Numbers of ``seq`` a folder of verdicts holds: a late stock change opens the folders from its own number on, not the others.
SPAN = 1_000_000


def judged(writes: DataFrame, versions: DataFrame) -> DataFrame:
    """Cart writes (seq, user_id, product_id, quantity) with the guard's reason, by the stock as of each write."""
    j = values_as_of(writes, versions, ["product_id"], ["seq"], ["stock"])
    reason = (F.when(F.col("quantity") <= 0, F.lit(MSG_POSITIVE))
               .when(F.col("stock").isNull() | (F.col("quantity") > F.col("stock")), F.lit(MSG_EXCEEDS)))
    return j.select(F.floor(F.col("seq") / SPAN).alias("span"), "seq", "user_id", "product_id", "quantity", reason.alias("reason"))


def start_cart_guard_as_of(events: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """X4 against current stock. One stream brings cart writes (op add / set, quantity) and stock changes (op stock, the new stock).

    A write is judged by its product's latest stock change with a ``seq`` not after its own. A stock change that comes
    after writes it bears on judges them anew, so the verdicts do not depend on how the stream is cut or ordered. ``seq`` is unique
    among the writes. A batch reads the stock changes (three numbers each) and, where it brings changes, the verdicts from the earliest one on."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = LatestTable(spark, f"{out}/versions", _VERSION_KEYS)
        verdicts = LatestTable(spark, f"{out}/verdicts", _VERDICT_KEYS, partition_by=["span"])
        batch = batch.persist()
        new = batch.filter(F.col("op") == "stock").groupBy(*_VERSION_KEYS).agg(F.max("quantity").alias("stock"))
        writes = batch.filter(F.col("op").isin("add", "set")).select(*_WRITE_COLUMNS)
        known = versions.read(new.schema, batch_id - 1).join(new, _VERSION_KEYS, "left_anti").unionByName(new)
        first = batch.filter(F.col("op") == "stock").agg(F.min("seq")).first()[0]
        if first is not None:  # writes already judged that the new changes bear on
            since = new.groupBy("product_id").agg(F.min("seq").alias("since"))
            seen = verdicts.read(_verdict_schema(spark), batch_id - 1).filter(F.col("span") >= first // SPAN)
            again = seen.join(since, "product_id").filter(F.col("seq") >= F.col("since"))
            writes = writes.unionByName(again.select(*_WRITE_COLUMNS))
        result = judged(writes, known)
        verdicts.write(result.repartition("span", F.pmod(F.xxhash64("seq"), F.lit(_SPAN_FILES))), batch_id)
        versions.write(new, batch_id)
        batch.unpersist()

    return _start(events.writeStream.foreachBatch(sink), checkpoint, trigger)


_WRITE_COLUMNS = ["seq", "user_id", "product_id", "quantity"]
#: Tasks that write a folder of verdicts at most, so that one full span is not one task's.
_SPAN_FILES = 8


def _verdict_schema(spark: SparkSession) -> StructType:
    return spark.range(0).selectExpr("id AS span", "id AS seq", "id AS user_id", "id AS product_id", "0 AS quantity", "'' AS reason").schema


def read_cart_guard_as_of(spark: SparkSession, out: str) -> DataFrame:
    """Every write's verdict by what the stream has told so far."""
    rows = LatestTable(spark, f"{out}/verdicts", _VERDICT_KEYS).read(_verdict_schema(spark))
    return rows.select(*_WRITE_COLUMNS, "reason", F.col("reason").isNull().alias("accepted"))


def stream_cart_guard_as_of(spark: SparkSession, events: DataFrame) -> DataFrame:
    return read_cart_guard_as_of(spark, replay(spark, "cart-guard-as-of", events, start_cart_guard_as_of))


# ------------------------------------------------------------------ X5
_DAY_KEYS, _ORDER_KEYS = ["order_date"], ["order_quarter", "order_day", "order_id"]
#: Quarters a batch may name for its order rows to be looked up by folder; a batch of more reads the whole table.
_MOST_QUARTERS = 1000
_DAY_SUMS = ["subtotal", "delivery_fees", "taxes", "revenue"]


def order_sums(lines: DataFrame) -> DataFrame:
    """Subtotal of each order's lines, with its creation day and quarter as texts ('none' without a time)."""
    text = lambda form: F.coalesce(F.date_format("created_at", form), F.lit("none"))
    return lines.groupBy(text("yyyy-'Q'q").alias("order_quarter"), text("yyyy-MM-dd").alias("order_day"), "order_id") \
        .agg(sum_of_lines(F.col("quantity"), F.col("price")).alias("subtotal"))


def order_images(added: DataFrame, orders: DataFrame) -> DataFrame:
    """(keys, old subtotal or null, new subtotal) of each order that ``added`` sums add to; ``orders`` holds the subtotals before."""
    before = orders.select(*_ORDER_KEYS, F.col("subtotal").alias("old"))
    return added.join(before, _ORDER_KEYS, "left").select(
        *_ORDER_KEYS, "old", money(F.coalesce("old", F.lit(0)) + F.col("subtotal")).alias("new"))


def day_differences(images: DataFrame) -> DataFrame:
    """What the changed orders add to each day: their new totals less their old ones (tax is rounded per order)."""
    def side(column: str, sign: int) -> DataFrame:
        t = with_totals(images.filter(F.col(column).isNotNull()).select("order_day", F.col(column).alias("subtotal")))
        return t.select("order_day", F.lit(sign).alias("total_orders"), *[
            (F.col(c) * sign).alias(n) for c, n in zip(("subtotal", "delivery_fee", "tax_amount", "total_amount"), _DAY_SUMS)])

    both = side("new", 1).unionByName(side("old", -1))
    return both.groupBy(F.when(F.col("order_day") != "none", F.to_date("order_day")).alias("order_date")).agg(
        F.sum("total_orders").cast("long").alias("total_orders"), *[money(F.sum(c)).alias(c) for c in _DAY_SUMS])


def start_daily_sales(lines: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """X5. Daily sales over order lines of live orders, kept by change images.

    A batch's lines give each order they touch an old and a new subtotal; the order table, in folders by quarter, takes the new
    one, and the touched days take the difference of the two. No day is summed anew and only
    the touched quarters' orders are looked up. A line of any age corrects its day; a replayed batch starts from the state before it."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        orders = LatestTable(spark, f"{out}/orders", _ORDER_KEYS, partition_by=["order_quarter"])
        days = LatestTable(spark, f"{out}/days", _DAY_KEYS)
        sums = order_sums(batch).persist()
        quarters = [r[0] for r in sums.select("order_quarter").distinct().limit(_MOST_QUARTERS + 1).collect()]
        before = orders.read(sums.schema, batch_id - 1)
        if len(quarters) <= _MOST_QUARTERS:
            before = before.filter(F.col("order_quarter").isin(quarters))
        images = order_images(sums, before).persist()
        changed = images.select(*_ORDER_KEYS, F.col("new").alias("subtotal"))
        tasks = tasks_for(sums.count())  # a file a quarter; a batch of many orders spreads them over more
        changed = changed.repartition("order_quarter") if tasks is None else \
            changed.repartition(tasks, "order_quarter", F.pmod(F.xxhash64("order_id"), F.lit(-(-tasks // max(1, len(quarters))))))
        orders.write(changed, batch_id)
        added = day_differences(images)
        both = added.withColumn("touched", F.lit(True)).unionByName(
            days.read(added.schema, batch_id - 1).withColumn("touched", F.lit(False)))
        total = both.groupBy("order_date").agg(
            F.sum("total_orders").alias("total_orders"), *[money(F.sum(c)).alias(c) for c in _DAY_SUMS], F.max("touched").alias("touched"))
        total = total.filter("touched").drop("touched")
        days.write(total.repartition(1), batch_id)  # a row a day; summed in tasks of its own (coalesce would sum all partitions in one task)
        images.unpersist()
        sums.unpersist()

    return _start(lines.writeStream.foreachBatch(sink), checkpoint, trigger)


def read_daily_sales(spark: SparkSession, out: str) -> DataFrame:
    m = "CAST(0 AS decimal(38,2))"
    schema = spark.range(0).selectExpr("CAST(NULL AS date) AS order_date", "id AS total_orders", f"{m} AS subtotal",
                                       f"{m} AS delivery_fees", f"{m} AS taxes", f"{m} AS revenue").schema
    return LatestTable(spark, f"{out}/days", _DAY_KEYS).read(schema)


def stream_daily_sales(spark: SparkSession, lines: DataFrame) -> DataFrame:
    feed = lines.select("order_id", "created_at", "quantity", "price")
    return read_daily_sales(spark, replay(spark, "daily-sales", feed, start_daily_sales))
