"""Audit log rows the reference's triggers write (X2, batch form)."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions.text import ts_literal
from souk.plans.numbering import previous_values
from souk.sources.schema import SCHEMAS

# The triggers' detail texts, with the row's values in place of the names in braces.
DETAIL_REVIEW = "Product {product_id} rated {rating}/5"
DETAIL_REVIEW_GONE = "Deleted review for product {product_id}"
DETAIL_PRODUCT = "Product added: {name}"
DETAIL_STATUS = "{old_status} -> {new_status}"

DEFAULT_AS_OF = dt.datetime(2000, 1, 1)


def _row(table: str, action: str, record_id, details, created_at) -> list:
    return [F.lit(table).alias("table_name"), F.lit(action).alias("action_type"),
            record_id.cast("bigint").alias("record_id"), details.alias("details"),
            created_at.alias("created_at")]


def _text(template: str) -> Column:
    """The template with columns in place of ``{column}``; NULL where one of them is NULL."""
    parts = [F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(re.split(r"[{}]", template))]
    return F.concat(*parts)


def review_audit(review_changes: DataFrame) -> DataFrame:
    """Review insert / delete trigger rows."""
    ins = review_changes.filter(F.col("op") == "INSERT").select(*_row(
        "reviews", "INSERT", F.col("review_id"),
        _text(DETAIL_REVIEW), F.col("changed_at")))
    dele = review_changes.filter(F.col("op") == "DELETE").select(*_row(
        "reviews", "DELETE", F.col("review_id"),
        _text(DETAIL_REVIEW_GONE), F.col("changed_at")))
    return ins.unionByName(dele)


def product_insert_audit(new_products: DataFrame) -> DataFrame:
    return new_products.select(*_row("products", "INSERT", F.col("id"),
                                     _text(DETAIL_PRODUCT), F.col("created_at")))


def status_change_audit(changes: DataFrame, time_col: str = "created_at") -> DataFrame:
    """Rows for (order_id, old_status, new_status) where the status really changed.

    A NULL on either side writes nothing, as ``OLD.status <> NEW.status`` is not true then.
    """
    return changes.filter(F.col("old_status") != F.col("new_status")).select(*_row(
        "orders", "STATUS_CHANGE", F.col("order_id"),
        _text(DETAIL_STATUS), F.col(time_col)))


def order_status_transitions(events: DataFrame) -> DataFrame:
    """Consecutive status pairs per order from a time-ordered status event feed.

    The previous status comes from the bucketed ``previous_values``, so an
    order with an unusually long history is not processed by one task.
    """
    prev = previous_values(events.select("order_id", "status", "event_time"), ["order_id"], ["event_time"],
                           ["status"])
    return prev.select("order_id", F.col("prev_status").alias("old_status"), F.col("status").alias("new_status"),
                       "event_time")


def feed_status_changes(orders: DataFrame, feed: DataFrame, as_of: dt.datetime = DEFAULT_AS_OF) -> DataFrame:
    """Old and new status for each request of an order-status feed applied in ``seq`` order."""
    from souk.operators.changes import order_status_updates

    upd = previous_values(order_status_updates(orders, feed), ["order_id"], ["seq"], ["new_status"])
    return upd.select("order_id", F.coalesce("prev_new_status", "old_status").alias("old_status"), "new_status",
                      ts_literal(as_of).alias("created_at"))


def append_audit(rows: DataFrame, path: str) -> int:
    """S7. Append audit rows to the append-only audit table at ``path``.

    Ids continue after the table's current maximum, in (created_at, table,
    record, action, details) order, numbered in parallel. Existing rows are
    never rewritten. One writer at a time: two that append together would read
    the same maximum. Returns the number of rows appended.
    """
    from souk.plans.numbering import number_rows
    from souk.sources.tables import conform

    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    start = spark.read.parquet(path).select(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0] if exists else 1
    staged = rows.select("table_name", "action_type", "record_id", "details", "created_at")
    numbered = number_rows(staged, ["created_at", "table_name", "record_id", "action_type", "details"], "id", start=start)
    conform(numbered, "audit_log").write.mode("append").parquet(path)
    return numbered.count()


#: An audit id is the writer's number, its batch's number and the row's place in the batch, side by side in 63 bits.
WRITER_BITS, BATCH_BITS, ROW_BITS = 9, 22, 32


def append_audit_batch(rows: DataFrame, path: str, writer: int, batch_id: int) -> None:
    """S7. Append a batch of audit rows to the table at ``path``, once however often it is tried.

    Every (writer, batch) has its own folder and its own range of ids: a batch written again replaces its own rows and no other's, and
    writers with different numbers append side by side without reading the table or each other. Ids are unique and ascend in (created_at,
    table, record, action, details) order within a batch; a writer's later batches have larger ids."""
    from souk.plans.numbering import number_rows
    from souk.session import discard
    from souk.sources.tables import conform

    if not (0 <= writer < 1 << WRITER_BITS and 0 <= batch_id < 1 << BATCH_BITS):
        raise ValueError(f"audit writer {writer} or batch {batch_id} is out of range")
    staged = rows.select("table_name", "action_type", "record_id", "details", "created_at")
    first = (writer << BATCH_BITS | batch_id) << ROW_BITS
    numbered = number_rows(staged, ["created_at", "table_name", "record_id", "action_type", "details"], "id", start=first)
    fits = F.when(F.col("id") < F.lit(first + (1 << ROW_BITS)), F.col("id")).otherwise(F.raise_error(F.lit("too many audit rows in a batch")))
    conform(numbered.withColumn("id", fits), "audit_log").write.mode("overwrite").parquet(f"{path}/writer={writer}/batch={batch_id}")
    discard(numbered)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit table that ``append_audit_batch`` keeps, without its folders' numbers."""
    return spark.read.schema(SCHEMAS["audit_log"]).option("basePath", path).parquet(f"{path}/writer=*/batch=*") \
        .select(*SCHEMAS["audit_log"].fieldNames())
