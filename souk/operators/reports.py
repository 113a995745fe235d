"""Report aggregates.

Shape rule used throughout: aggregate the fact table on its own key first
(partial + final aggregation), then join the much smaller result to the
dimensions. Dimension joins carry no broadcast hint: AQE converts them to
broadcast joins only when the measured side is under
``spark.sql.adaptive.autoBroadcastJoinThreshold``; larger dimensions stay
sort-merge (and skewed keys are split by AQE's skew-join handling).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.money import (DELIVERY_FEE, TAX_RATE, average_money, average_rating, line_amount, money,
                                  sum_of_lines, with_totals)
from souk.sources.tables import Tables


def live_orders(orders: DataFrame) -> DataFrame:
    """Orders that are not cancelled (P2). A NULL status is dropped, as in SQL."""
    return orders.filter(F.col("status") != "cancelled")


def order_subtotals(items: DataFrame) -> DataFrame:
    """Per order: sum(quantity * price) over its lines. Lines are summed exactly."""
    return items.groupBy("order_id").agg(sum_of_lines(F.col("quantity"), F.col("price")).alias("subtotal"))


def order_totals(t: Tables, fee: Decimal = DELIVERY_FEE, rate: Decimal = TAX_RATE) -> DataFrame:
    """A1. One row per order that has at least one line (orders without lines vanish, Q4)."""
    sub = order_subtotals(t.order_items)
    existing = t.orders.select(F.col("id").alias("order_id"))
    return with_totals(sub.join(existing, "order_id", "left_semi"), fee=fee, rate=rate)


def sales_summary(t: Tables) -> DataFrame:
    """A3. Store-wide non-cancelled order count, revenue and average order value; 0 on empty input."""
    live = live_orders(t.orders).select(F.col("id").alias("order_id"))
    tot = with_totals(order_subtotals(t.order_items).join(live, "order_id"))
    agg = tot.agg(F.count(F.lit(1)).alias("total_orders"), money(F.sum("total_amount")).alias("revenue_sum"))
    return agg.select(
        "total_orders",
        F.coalesce(F.col("revenue_sum"), money(F.lit(0))).alias("revenue"),
        average_money("revenue_sum", "total_orders").alias("avg_order"))


def daily_sales(t: Tables) -> DataFrame:
    """A4. Per calendar day (session time zone) of non-cancelled orders that have lines."""
    live = live_orders(t.orders).select(F.col("id").alias("order_id"),
                                        F.to_date("created_at").alias("order_date"))
    tot = with_totals(order_subtotals(t.order_items).join(live, "order_id"))
    return tot.groupBy("order_date").agg(
        F.count(F.lit(1)).alias("total_orders"),
        money(F.sum("subtotal")).alias("subtotal"),
        money(F.sum("delivery_fee")).alias("delivery_fees"),
        money(F.sum("tax_amount")).alias("taxes"),
        money(F.sum("total_amount")).alias("revenue"))


def top_products(t: Tables, n: int = 10) -> DataFrame:
    """A5. Top-n products by units sold on non-cancelled orders; ties broken by product id."""
    live = live_orders(t.orders).select(F.col("id").alias("order_id"))
    per_product = (t.order_items.join(live, "order_id")
                   .groupBy("product_id")
                   .agg(F.sum("quantity").cast("bigint").alias("units_sold"),
                        money(F.sum(line_amount(F.col("quantity"), F.col("price")))).alias("revenue")))
    named = per_product.join(t.products.select(F.col("id").alias("product_id"), "name"), "product_id")
    return named.orderBy(F.desc("units_sold"), F.asc("product_id")).limit(n) \
                .select("product_id", "name", "units_sold", "revenue")


def review_aggregates(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("product_id").agg(
        F.count("id").alias("review_count"),
        F.count("rating").alias("rated_count"),
        F.sum("rating").cast("bigint").alias("rating_sum"))


def rating_summary(t: Tables) -> DataFrame:
    """A6. Count and average rating per product; products without reviews get zeros."""
    agg = review_aggregates(t.reviews)
    joined = t.products.select(F.col("id").alias("product_id")).join(agg, "product_id", "left")
    return joined.select(
        "product_id",
        F.coalesce(F.col("review_count"), F.lit(0)).cast("bigint").alias("review_count"),
        average_rating("coalesce(rating_sum, 0)", "coalesce(rated_count, 0)").alias("average_rating"))


def product_average_rating(t: Tables, product_id: int | None = None) -> DataFrame:
    """A11 / U1. Live average rating per product (0 when unreviewed), optionally one product."""
    s = rating_summary(t).select("product_id", "average_rating")
    return s if product_id is None else s.filter(F.col("product_id") == product_id)


def category_product_counts(t: Tables) -> DataFrame:
    """A7. Products per category, categories without products kept with 0."""
    counts = t.products.groupBy(F.col("category_id").alias("id")).agg(F.count("id").alias("product_count"))
    return (t.categories.join(counts, "id", "left")
            .select("id", "name", F.coalesce("product_count", F.lit(0)).cast("bigint").alias("product_count"))
            .orderBy("name", "id"))


def _sellers(users: DataFrame) -> DataFrame:
    return users.filter(F.col("role") == "seller").select(F.col("id").alias("seller_id"),
                                                          F.col("name").alias("seller_name"))


def seller_sales(t: Tables) -> DataFrame:
    """A8. Order lines per seller whose order exists, cancelled included (Q3)."""
    existing = t.orders.select(F.col("id").alias("order_id"))
    per_product = (t.order_items.join(existing, "order_id", "left_semi")
                   .groupBy("product_id").agg(F.count(F.lit(1)).alias("lines")))
    per_seller = (per_product.join(t.products.select(F.col("id").alias("product_id"), "seller_id"), "product_id")
                  .groupBy("seller_id").agg(F.sum("lines").alias("lines")))
    return (_sellers(t.users).join(per_seller, "seller_id", "left")
            .select(F.col("seller_id").alias("id"), F.col("seller_name").alias("name"),
                    F.coalesce("lines", F.lit(0)).cast("bigint").alias("total_orders")))


def _seller_order_grain(t: Tables) -> DataFrame:
    """(seller, order) rows with units, amount and whether the order is live.

    Distinct-order counting happens on this grain, so no distinct expansion
    is needed at the seller level.
    """
    orders = t.orders.select(F.col("id").alias("order_id"),
                             (F.col("status") != "cancelled").alias("live"))
    lines = t.order_items.join(orders, "order_id", "left")
    with_seller = lines.join(t.products.select(F.col("id").alias("product_id"), "seller_id"), "product_id")
    return with_seller.groupBy("seller_id", "order_id").agg(
        F.sum("quantity").alias("units"),
        F.sum(line_amount(F.col("quantity"), F.col("price"))).alias("amount"),
        F.max(F.coalesce("live", F.lit(False))).alias("live"))


def seller_revenue(t: Tables, net: bool = False) -> DataFrame:
    """A9. Distinct live orders, units and revenue per seller, ordered by revenue.

    Gross form (default) sums every line, cancelled orders included (Q1); the
    net form sums only lines of live orders.
    """
    g = _seller_order_grain(t)
    if net:
        g = g.filter("live")
    per_seller = g.groupBy("seller_id").agg(
        F.count_if(F.col("live")).alias("orders_count"),
        F.sum("units").alias("units_sold"),
        F.sum("amount").alias("revenue"))
    out = _sellers(t.users).join(per_seller, "seller_id", "left").select(
        "seller_id", "seller_name",
        F.coalesce("orders_count", F.lit(0)).cast("bigint").alias("orders_count"),
        F.coalesce("units_sold", F.lit(0)).cast("bigint").alias("units_sold"),
        money(F.coalesce("revenue", F.lit(0))).alias("seller_revenue"))
    return out.orderBy(F.desc("seller_revenue"), "seller_id")


def category_revenue(t: Tables, net: bool = False) -> DataFrame:
    """A10. Per category: joined-row count (Q2) and revenue, gross or net."""
    items = t.order_items
    if net:
        live = live_orders(t.orders).select(F.col("id").alias("order_id"))
        items = items.join(live, "order_id", "left_semi")
    per_product = items.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(line_amount(F.col("quantity"), F.col("price"))).alias("amount"))
    prods = t.products.select(F.col("id").alias("product_id"), "category_id").join(per_product, "product_id", "left")
    if net:
        per_cat = prods.groupBy("category_id").agg(F.count("product_id").alias("product_count"),
                                                   F.sum("amount").alias("revenue"))
    else:
        per_cat = prods.groupBy("category_id").agg(
            F.sum(F.greatest(F.coalesce("lines", F.lit(0)), F.lit(1))).alias("product_count"),
            F.sum("amount").alias("revenue"))
    out = t.categories.select(F.col("id").alias("category_id"), "name").join(per_cat, "category_id", "left").select(
        "category_id", "name",
        F.coalesce("product_count", F.lit(0)).cast("bigint").alias("product_count"),
        money(F.coalesce("revenue", F.lit(0))).alias("revenue"))
    return out.orderBy(F.desc("revenue"), "category_id")


def cart_totals(t: Tables) -> DataFrame:
    """A2. Checkout quote per user with a non-empty cart, same formula as order totals."""
    lines = t.cart.join(t.products.select(F.col("id").alias("product_id"), "price"), "product_id")
    agg = lines.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("quantity").cast("bigint").alias("units"),
        sum_of_lines(F.col("quantity"), F.col("price")).alias("subtotal"))
    return with_totals(agg)
