"""Listings and per-user pages, computed for every user at once.

The reference answers these for one user per request (``WHERE user_id = ?``);
each function here takes an optional id and otherwise covers all users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.money import DELIVERY_FEE, line_amount, money
from souk.operators.reports import order_totals
from souk.plans.numbering import running_sums
from souk.sources.tables import Tables


def _maybe_user(df: DataFrame, user_id: int | None, col: str = "user_id") -> DataFrame:
    return df if user_id is None else df.filter(F.col(col) == user_id)


def user_listing(t: Tables) -> DataFrame:
    """P6. Users without credentials, newest first (id breaks ties)."""
    return t.users.select("id", "name", "email", "role", "account_status", "created_at") \
                  .orderBy(F.desc("created_at"), "id")


def category_listing(t: Tables) -> DataFrame:
    """P7. Categories by name."""
    return t.categories.select("id", "name").orderBy("name", "id")


def default_address(t: Tables) -> DataFrame:
    """P10. One address per user: default first, then lowest id.

    A min-of-struct aggregation instead of a per-user window, so partial
    aggregation absorbs users with very many addresses.
    """
    rank = F.when(F.col("is_default"), 0).when(~F.col("is_default"), 1).otherwise(2)
    best = t.user_addresses.groupBy("user_id").agg(
        F.min(F.struct(rank.alias("r"), "id", "phone", "city", "address", "is_default", "created_at")).alias("a"))
    return best.select("user_id", F.col("a.id").alias("id"), "a.phone", "a.city", "a.address",
                       "a.is_default", "a.created_at")


def cart_lines(t: Tables, user_id: int | None = None) -> DataFrame:
    """J14. Cart lines with product data and line total, newest line first."""
    prods = t.products.select(F.col("id").alias("product_id"), "name", "price", "stock", "image_url")
    lines = _maybe_user(t.cart, user_id).join(prods, "product_id")
    return lines.select("id", "user_id", "product_id", "quantity", "name", "price", "stock", "image_url",
                        money(line_amount(F.col("quantity"), F.col("price"))).alias("line_total")) \
                .orderBy("user_id", F.desc("id"))


def cart_stock_violations(t: Tables) -> DataFrame:
    """P5. Cart lines asking for more than the product's stock."""
    prods = t.products.select(F.col("id").alias("product_id"), "stock")
    return t.cart.join(prods, "product_id").filter(F.col("quantity") > F.col("stock")) \
                 .select("id", "user_id", "product_id", "quantity", "stock")


def blocked_carts(t: Tables) -> DataFrame:
    """J6. Users whose cart has at least one line over stock (EXISTS as a semi join)."""
    carts = t.cart.select("user_id").distinct()
    return carts.join(cart_stock_violations(t).select("user_id"), "user_id", "left_semi")


def order_history(t: Tables, user_id: int | None = None) -> DataFrame:
    """J8. Orders with totals, payment and invoice; itemless orders show 0 / 10.00 / 0 / 0 (Q5).

    All three right sides are keyed by order id, so the joins share one
    partitioning of the orders.
    """
    o = _maybe_user(t.orders, user_id)
    tot = order_totals(t).withColumnRenamed("order_id", "id")
    pay = t.payments.select(F.col("order_id").alias("id"), "payment_method", "card_last4", "payment_status")
    inv = t.invoices.select(F.col("order_id").alias("id"), "invoice_number")
    j = o.join(tot, "id", "left").join(pay, "id", "left").join(inv, "id", "left")
    return j.select(
        "id", "user_id",
        F.coalesce("subtotal", money(F.lit(0))).alias("subtotal"),
        F.coalesce("delivery_fee", money(F.lit(DELIVERY_FEE))).alias("delivery_fee"),
        F.coalesce("tax_amount", money(F.lit(0))).alias("tax_amount"),
        F.coalesce("total_amount", money(F.lit(0))).alias("total_amount"),
        "status", "payment_method", "card_last4", "created_at",
        F.coalesce("payment_status", F.lit("pending")).alias("payment_status"),
        "invoice_number") \
        .orderBy("user_id", F.desc("created_at"), "id")


def _items_of(t: Tables, user_id: int | None) -> DataFrame:
    if user_id is None:
        return t.order_items
    mine = t.orders.filter(F.col("user_id") == user_id).select(F.col("id").alias("order_id"))
    return t.order_items.join(mine, "order_id", "left_semi")


def order_item_lines(t: Tables, user_id: int | None = None) -> DataFrame:
    """J9. Every order's lines with product name, in one join (no per-order query)."""
    items = _items_of(t, user_id)
    prods = t.products.select(F.col("id").alias("product_id"), "name")
    return items.join(prods, "product_id").select("order_id", "product_id", "name", "quantity", "price")


def order_item_pages(t: Tables, page_lines: int = 100, user_id: int | None = None) -> DataFrame:
    """J9, nested. Every order's lines as arrays: (order_id, page, n_lines, lines), pages from 1, lines by item id.

    A page holds at most ``page_lines`` lines, so no row holds an unbounded order; lines are counted in buckets of the item id,
    so no task does either. Lines whose product is unknown are left out, as in the flat form."""
    names = t.products.select(F.col("id").alias("product_id"), "name")
    lines = _items_of(t, user_id).join(names, "product_id")
    placed = running_sums(lines, ["order_id"], ["id"], {"line": F.lit(1)}, inclusive=True)
    line = F.struct(F.col("line").cast("bigint").alias("line"), "product_id", "name", "quantity", "price")
    return placed.groupBy("order_id", F.expr(f"CAST((line - 1) div {int(page_lines)} + 1 AS bigint)").alias("page")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sort_array(F.collect_list(line)).alias("lines"))


def unnest_pages(pages: DataFrame) -> DataFrame:
    """The lines of ``order_item_pages``, one row each, with their page and place in the order."""
    return pages.select("order_id", "page", "n_lines", F.inline("lines"))


def admin_order_listing(t: Tables) -> DataFrame:
    """J10. Orders with customer name and total (0 when itemless), newest first."""
    users = t.users.select(F.col("id").alias("user_id"), F.col("name").alias("customer_name"))
    tot = order_totals(t).select(F.col("order_id").alias("id"), "total_amount")
    j = t.orders.join(users, "user_id").join(tot, "id", "left")
    return j.select("id", "status", "created_at", "customer_name",
                    F.coalesce("total_amount", money(F.lit(0))).alias("total_amount")) \
            .orderBy(F.desc("created_at"), "id")


def admin_product_listing(t: Tables) -> DataFrame:
    """J11. Products with category and seller names, newest first."""
    cats = t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    sellers = t.users.select(F.col("id").alias("seller_id"), F.col("name").alias("seller_name"))
    j = t.products.join(cats, "category_id").join(sellers, "seller_id")
    return j.select("id", "name", "price", "stock", "image_url", "category_name", "seller_name", "created_at") \
            .orderBy(F.desc("created_at"), "id")


def admin_review_listing(t: Tables) -> DataFrame:
    """J12. Reviews with customer and product names, newest first."""
    users = t.users.select(F.col("id").alias("user_id"), F.col("name").alias("customer_name"))
    prods = t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    j = t.reviews.join(users, "user_id").join(prods, "product_id")
    return j.select("id", "rating", "comment", "created_at", "customer_name", "product_name") \
            .orderBy(F.desc("created_at"), "id")
