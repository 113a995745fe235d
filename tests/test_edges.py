"""Edge cases: empty tables, all orders cancelled, NULL status, empty groups."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from souk.operators import catalog, checkout, listings, quality, reports, reviews


def _empty(seed):
    return seed.with_(**{name: df.limit(0) for name, df in seed.items()})


def test_reports_on_empty_tables(seed):
    t = _empty(seed)
    assert reports.order_totals(t).count() == 0
    assert reports.daily_sales(t).count() == 0
    s = reports.sales_summary(t).collect()[0]
    assert (s["total_orders"], s["revenue"], s["avg_order"]) == (0, D("0.00"), D("0.00"))
    assert reports.top_products(t).count() == 0
    assert reports.seller_revenue(t).count() == 0
    assert quality.check_references(t).count() == 0 and quality.check_unique(t).count() == 0


def test_checkout_with_no_requests(spark, seed):
    req = spark.createDataFrame([], "seq long, user_id long, address_id long, payment_method string, "
                                    "card_last4 string")
    res = checkout.checkout(seed, req)
    assert res.decisions.count() == 0 and res.orders.count() == 0
    assert {r["id"]: r["stock"] for r in res.stock.collect()} == {r["id"]: r["stock"] for r in seed.products.collect()}


def test_empty_cart_is_rejected(spark, seed):
    req = spark.createDataFrame([(1, 1, None, "cash", None)],
                                "seq long, user_id long, address_id long, payment_method string, card_last4 string")
    d = checkout.checkout(seed, req).decisions.collect()[0]
    assert d["decision"] == "rejected" and d["reason"] == "Cart is empty"


def test_all_orders_cancelled(seed):
    t = seed.with_(orders=seed.orders.withColumn("status", F.lit("cancelled")))
    assert reports.daily_sales(t).count() == 0
    assert reports.sales_summary(t).collect()[0]["total_orders"] == 0
    net = {r["seller_id"]: r for r in reports.seller_revenue(t, net=True).collect()}
    assert all(r["seller_revenue"] == D("0.00") and r["orders_count"] == 0 for r in net.values())
    gross = {r["seller_id"]: r["seller_revenue"] for r in reports.seller_revenue(t).collect()}
    assert gross[3] > 0  # Q1: gross keeps cancelled lines


def test_null_status_is_neither_live_nor_cancelled(seed):
    t = seed.with_(orders=seed.orders.withColumn(
        "status", F.when(F.col("id") == 10001, F.lit(None)).otherwise(F.col("status"))))
    assert 10001 not in {r["order_id"] for r in reports.order_totals(t).join(
        reports.live_orders(t.orders).select(F.col("id").alias("order_id")), "order_id").collect()}
    rows = {r["record_id"] for r in quality.check_rows(t).filter("rule = 'status allowed'").collect()}
    assert 10001 not in rows  # a NULL passes a CHECK


def test_seller_and_category_without_products(spark, seed):
    users = seed.users.unionByName(spark.createDataFrame(
        [(7, "Seller Seven", "seller.seven@example.com", "seller", "active", None)], seed.users.schema))
    cats = seed.categories.unionByName(spark.createDataFrame([(8, "Hats")], seed.categories.schema))
    t = seed.with_(users=users, categories=cats)
    s = {r["id"]: r["total_orders"] for r in reports.seller_sales(t).collect()}
    assert s[7] == 0
    c = {r["id"]: r["product_count"] for r in reports.category_product_counts(t).collect()}
    assert c[8] == 0
    r = {r["category_id"]: (r["product_count"], r["revenue"]) for r in reports.category_revenue(t).collect()}
    assert r[8] == (0, D("0.00"))


def test_unreviewed_product_and_reviewable(seed):
    avg = {r["product_id"]: r["average_rating"] for r in reports.product_average_rating(seed).collect()}
    assert avg[1] == D("0.00")
    # no delivered orders in the seed: nothing is reviewable yet
    assert reviews.reviewable_products(seed).count() == 0
    assert listings.order_history(seed, user_id=6).count() == 2
    assert catalog.seller_catalog(seed, seller_id=3).count() == 4
