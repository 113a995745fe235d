"""Review jobs: reviewable products, eligibility, a user's reviews, bulk submissions
(J5, J7, J13, M4)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.text import php_trim, ts_literal
from souk.operators.changes import mark_delivered
from souk.plans.numbering import number_rows
from souk.plans.tasks import spread
from souk.sources.tables import Tables, conform

# Messages of the review form.
NOT_DELIVERED = "You can review this product after the order is delivered."
ALREADY_REVIEWED = "You already reviewed this product."
DEFAULT_AS_OF = dt.datetime(2000, 1, 1)


def delivered_pairs(t: Tables) -> DataFrame:
    """Distinct (user, product) pairs with at least one delivered order line."""
    delivered = t.orders.filter(F.col("status") == "delivered").select(F.col("id").alias("order_id"), "user_id")
    pairs = t.order_items.select("order_id", "product_id").join(delivered, "order_id").select("user_id", "product_id")
    return spread(pairs, t.rows("order_items"), "user_id", "product_id").distinct()


def reviewable_products(t: Tables, user_id: int | None = None) -> DataFrame:
    """J5. Delivered products a user has not reviewed (anti join written directly)."""
    pairs = delivered_pairs(t)
    if user_id is not None:
        pairs = pairs.filter(F.col("user_id") == user_id)
    todo = pairs.join(t.reviews.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti")
    names = t.products.select(F.col("id").alias("product_id"), "name")
    return todo.join(names, "product_id").select("user_id", "product_id", "name").orderBy("user_id", "name",
                                                                                        "product_id")


def review_eligibility(feed: DataFrame, t: Tables) -> DataFrame:
    """J7. Feed rows whose user has a delivered order of the product (LIMIT 1 test as a semi join)."""
    return feed.join(delivered_pairs(t), ["user_id", "product_id"], "left_semi")


def user_reviews(t: Tables, user_id: int | None = None) -> DataFrame:
    """J13. Each user's reviews with product name, newest first."""
    r = t.reviews if user_id is None else t.reviews.filter(F.col("user_id") == user_id)
    names = t.products.select(F.col("id").alias("product_id"), "name")
    return r.join(names, "product_id").select("id", "user_id", "name", "rating", "comment", "created_at") \
            .orderBy("user_id", F.desc("created_at"), "id")


def apply_reviews(t: Tables, feed: DataFrame, as_of: dt.datetime = DEFAULT_AS_OF,
                  deliver_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """M4. Apply review submissions in ``seq`` order; return (reviews, rejects).

    A submission is accepted when the user has a delivered order of the
    product, has no review of it yet, and no earlier accepted submission in
    the feed covers the same pair. Ratings are clamped to 1..5 and comments
    trimmed. New ids continue after the current maximum, in feed order. With
    ``deliver_first`` orders due at ``as_of`` are marked delivered before the check,
    as the page does.
    """
    sub = feed.select("seq", "user_id", "product_id",
                      F.greatest(F.lit(1), F.least(F.lit(5), F.col("rating"))).cast("int").alias("rating"),
                      php_trim(F.col("comment")).alias("comment"))
    if deliver_first:
        t = t.with_(orders=mark_delivered(t.orders, as_of))
    # One table of facts per pair: its first submission, whether it was delivered, whether it has a review.
    no = F.lit(False)
    facts = (sub.select("user_id", "product_id", "seq", no.alias("d"), no.alias("r"))
             .unionByName(delivered_pairs(t).select("user_id", "product_id", F.lit(None).cast("bigint").alias("seq"), F.lit(True).alias("d"), no.alias("r")))
             .unionByName(t.reviews.select("user_id", "product_id", F.lit(None).cast("bigint").alias("seq"), no.alias("d"), F.lit(True).alias("r"))))
    facts = facts.groupBy("user_id", "product_id").agg(F.min("seq").alias("first_seq"), F.max("d").alias("delivered"), F.max("r").alias("reviewed"))
    decided = sub.join(facts, ["user_id", "product_id"]).withColumn(
        "reason",
        F.when(~F.col("delivered"), F.lit(NOT_DELIVERED))
         .when(F.col("reviewed") | (F.col("seq") != F.col("first_seq")), F.lit(ALREADY_REVIEWED)))
    accepted = decided.filter(F.col("reason").isNull())
    start = t.reviews.select(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()
    new_rows = number_rows(accepted, "seq", "id", start=start).select(
        "id", "user_id", "product_id", "rating", "comment", ts_literal(as_of).alias("created_at"))
    state = t.reviews.unionByName(conform(new_rows, "reviews"))
    rejects = decided.filter(F.col("reason").isNotNull()).select("seq", "user_id", "product_id", "reason")
    return state, rejects
