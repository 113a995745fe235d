"""Query registry: key -> callable(spark, sf_dir) -> DataFrame.

Every callable maps the driver's tables onto the marketplace schema and
runs one operator over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.operators import audit, cascades, catalog, changes, checkout, listings, quality, reports, reviews
from souk.plans.trigrams import trigrams, write_trigrams
from souk.session import scratch_dir, written
from souk.sources import feeds
from souk.sources.fixtures import Fixture
from souk.streaming import streams

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def _on_tables(key: str, fn):
    QUERIES[key] = lambda spark, sf_dir: fn(Fixture(spark, sf_dir).tables())


def _on_fixture(key: str, fn):
    QUERIES[key] = lambda spark, sf_dir: fn(Fixture(spark, sf_dir))


# reports
_on_tables("order_totals", reports.order_totals)
_on_tables("daily_sales", reports.daily_sales)
_on_tables("sales_summary", reports.sales_summary)
_on_tables("top_products", reports.top_products)
_on_tables("rating_summary", reports.rating_summary)
_on_tables("product_average_rating", reports.product_average_rating)
_on_tables("category_product_counts", reports.category_product_counts)
_on_tables("seller_sales", reports.seller_sales)
_on_tables("seller_revenue", reports.seller_revenue)
_on_tables("seller_revenue_net", lambda t: reports.seller_revenue(t, net=True))
_on_tables("category_revenue", reports.category_revenue)
_on_tables("category_revenue_net", lambda t: reports.category_revenue(t, net=True))
_on_tables("cart_totals", reports.cart_totals)

# catalog and listings
_on_tables("product_catalog", catalog.product_catalog)
_on_tables("product_catalog_full", catalog.product_catalog_full)
_on_tables("catalog_search", lambda t: catalog.catalog_search(t, search="Red"))
_on_tables("catalog_search_category", lambda t: catalog.catalog_search(t, category_id=1))
_on_tables("catalog_search_both", lambda t: catalog.catalog_search(t, search="Red", category_id=1))


def _indexed_search(search):
    """The catalog search by a stored trigram table of the product names."""
    def run(t):
        path = scratch_dir(t.products.sparkSession, "trigrams")
        write_trigrams(trigrams(t.products, "id", "name"), path)
        return catalog.catalog_search(t, search=search, grams=t.products.sparkSession.read.parquet(path))
    return run


_on_tables("catalog_search_indexed", _indexed_search("Red"))
_on_tables("catalog_search_indexed_wildcards", _indexed_search("Red%Wid_et"))
_on_tables("seller_catalog", catalog.seller_catalog)
_on_tables("catalog_card", lambda t: catalog.catalog_card(catalog.catalog_search(t)))
_on_fixture("catalog_feed_load",
            lambda fx: catalog.load_catalog_feed(feeds.catalog_feed(fx), fx.categories())[0])
_on_fixture("catalog_feed_rejects",
            lambda fx: catalog.load_catalog_feed(feeds.catalog_feed(fx), fx.categories())[1])
_on_fixture("catalog_reload", lambda fx: catalog.reload_catalog(fx.tables(), feeds.catalog_feed(fx)).products)
_on_tables("user_listing", listings.user_listing)
_on_tables("category_listing", listings.category_listing)
_on_tables("default_address", listings.default_address)
_on_tables("cart_lines", listings.cart_lines)
_on_tables("cart_stock_violations", listings.cart_stock_violations)
_on_tables("blocked_carts", listings.blocked_carts)
_on_tables("order_history", listings.order_history)
_on_tables("order_item_lines", listings.order_item_lines)
_on_tables("order_item_pages", lambda t: listings.unnest_pages(listings.order_item_pages(t, page_lines=3)))
_on_tables("admin_order_listing", listings.admin_order_listing)
_on_tables("admin_product_listing", listings.admin_product_listing)
_on_tables("admin_review_listing", listings.admin_review_listing)

# reviews
_on_tables("reviewable_products", reviews.reviewable_products)
_on_tables("user_reviews", reviews.user_reviews)
_on_fixture("review_eligibility",
            lambda fx: reviews.review_eligibility(feeds.review_feed(fx), fx.tables())
            .select("seq", "user_id", "product_id"))
_on_fixture("review_submissions", lambda fx: reviews.apply_reviews(fx.tables(), feeds.review_feed(fx))[0])
_on_fixture("review_submissions_after_delivery", lambda fx: reviews.apply_reviews(
    fx.tables(), feeds.review_feed(fx), deliver_first=True)[0])
_on_fixture("review_rejects", lambda fx: reviews.apply_reviews(fx.tables(), feeds.review_feed(fx))[1])

# change jobs
_on_fixture("product_changes", lambda fx: changes.apply_product_changes(fx.tables(), feeds.product_feed(fx))[0])
_on_fixture("product_change_rejects",
            lambda fx: changes.apply_product_changes(fx.tables(), feeds.product_feed(fx))[1])
_on_fixture("category_insert_ignore",
            lambda fx: changes.insert_ignore_categories(fx.categories(), feeds.category_feed(fx)))
_on_tables("mark_delivered", lambda t: changes.mark_delivered(t.orders))
_on_fixture("user_changes", lambda fx: changes.apply_user_changes(fx.users(), feeds.user_feed(fx)))
_on_fixture("order_status_changes",
            lambda fx: changes.apply_order_status(fx.orders(), feeds.order_status_feed(fx)))
_on_fixture("cart_changes", lambda fx: changes.apply_cart_changes(fx.tables(), feeds.cart_feed(fx))[0])
_on_fixture("cart_change_rejects", lambda fx: changes.apply_cart_changes(fx.tables(), feeds.cart_feed(fx))[1])
_on_fixture("address_upsert",
            lambda fx: changes.upsert_addresses(fx.tables(), feeds.address_feed(fx))[0])
_on_fixture("address_rejects",
            lambda fx: changes.upsert_addresses(fx.tables(), feeds.address_feed(fx))[1])


def _rating_summary_upsert(t):
    """A stored summary (reviews before 1997, no product with id % 3 = 0, counts off by a thousand as a mark) upserted with
    fresh rows for every product it misses or that got reviews since; untouched rows keep their mark."""
    cutoff = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    stale = reports.rating_summary(t.with_(reviews=t.reviews.filter(F.col("created_at") < cutoff))) \
        .filter(F.col("product_id") % 3 != 0).withColumn("review_count", F.col("review_count") + 1000)
    touched = t.reviews.filter(F.col("created_at") >= cutoff).select("product_id")
    fresh = reports.rating_summary(t)
    updates = fresh.join(stale.select("product_id"), "product_id", "left_anti").unionByName(
        fresh.join(touched, "product_id", "left_semi"))
    return changes.upsert(stale, updates.dropDuplicates(["product_id"]), ["product_id"])


_on_tables("rating_summary_upsert", _rating_summary_upsert)


def _cascade(table, victim):
    """Delete the row that ``victim`` picks; report the rows left per table, the stored summary included."""
    def run(t):
        t = t.with_(extras={"rating_summary": reports.rating_summary(t)})
        return changes.table_row_counts(cascades.cascade_delete(t, table, victim(t)))
    return run


_on_tables("cascade_delete_category", _cascade("categories", lambda t: t.products.agg(F.min("category_id").alias("id"))))
_on_tables("cascade_delete_user", _cascade("users", lambda t: t.products.agg(F.min("seller_id").alias("id"))))
_on_tables("cascade_delete_customer", _cascade("users", lambda t: t.reviews.agg(F.min("user_id").alias("id"))))
_on_tables("cascade_delete_product", _cascade("products", lambda t: t.order_items.agg(F.min("product_id").alias("id"))))
_on_tables("cascade_delete_order", _cascade("orders", lambda t: t.invoices.agg(F.min("order_id").alias("id"))))
_on_tables("cascade_delete_review", _cascade("reviews", lambda t: t.reviews.agg(F.min("id").alias("id"))))


def _cascade_rows(table, victims):
    """The deleted rows and lost references when the rows that ``victims`` picks are deleted."""
    def run(t):
        t = t.with_(extras={"rating_summary": reports.rating_summary(t)})
        return cascades.cascade_rows(t, table, victims(t))
    return run


_on_tables("cascade_rows_category", _cascade_rows("categories", lambda t: t.products.agg(F.min("category_id").alias("id"))))
_on_tables("cascade_rows_users", _cascade_rows("users", lambda t: t.users.filter("account_status = 'suspended'").select("id")))
_on_tables("cascade_rows_addresses", _cascade_rows("user_addresses", lambda t: t.user_addresses.filter("NOT is_default").select("id")))


# data quality
def _staged_reviews(fx):
    """Reviews plus the raw review feed staged as rows (unclamped, unchecked)."""
    staged = feeds.review_feed(fx).select(F.col("seq").alias("id"), "user_id", "product_id", "rating",
                                          "comment", F.lit(None).cast("timestamp_ntz").alias("created_at"))
    t = fx.tables()
    return t.with_(reviews=t.reviews.unionByName(staged), extras={
        "rows": t.extras["rows"] | {"reviews": lambda: t.rows("reviews") + fx.rows("lineitem")}})


_on_fixture("dq_row_checks", lambda fx: quality.check_rows(_staged_reviews(fx)))
_on_fixture("dq_unique", lambda fx: quality.check_unique(_staged_reviews(fx)))
_on_fixture("dq_contacts", lambda fx: quality.check_contacts(feeds.contacts(fx)))
_on_fixture("dq_references", lambda fx: quality.check_references(fx.tables().with_(  # five of its checks read the products
    products=written(changes.apply_product_changes(fx.tables(), feeds.product_feed(fx))[0], "changed-products"))))


# checkout
def _checkout(fx):
    return checkout.checkout(fx.tables(), feeds.checkout_requests(fx))


_on_fixture("checkout_decisions", lambda fx: _checkout(fx).decisions)
_on_fixture("checkout_stock", lambda fx: _checkout(fx).stock)
_on_fixture("checkout_orders", lambda fx: _checkout(fx).orders)



# audit log (batch form of the triggers)
def _new_products(fx):
    """The products that the product feed adds."""
    t = fx.tables()
    return changes.apply_product_changes(t, feeds.product_feed(fx))[0].join(t.products.select("id"), "id", "left_anti")


def _audit_log(fx):
    t = fx.tables()
    new_products = _new_products(fx)
    status = audit.feed_status_changes(t.orders, feeds.order_status_feed(fx))
    return (audit.review_audit(feeds.review_changes(fx))
            .unionByName(audit.product_insert_audit(new_products))
            .unionByName(audit.status_change_audit(status)))


_on_fixture("audit_log", _audit_log)
_on_fixture("order_status_audit", lambda fx: audit.status_change_audit(
    audit.order_status_transitions(feeds.order_status_events(fx)), time_col="event_time"))


# streams
def _stream_lines(fx):
    t = fx.tables()
    live = reports.live_orders(t.orders).select(F.col("id").alias("order_id"), "created_at")
    return t.order_items.join(live, "order_id").select("order_id", "created_at", "quantity", "price")


_on_fixture("stream_rating_summary", lambda fx: streams.stream_rating_summary(
    fx.spark, streams.rating_change_feed(feeds.review_changes(fx), fx.products())))
_on_fixture("stream_mark_delivered", lambda fx: streams.stream_mark_delivered(fx.spark, feeds.order_status_events(fx)))
_on_fixture("stream_cart_guard", lambda fx: streams.stream_cart_guard(fx.spark, feeds.cart_feed(fx), fx.products()))
_on_fixture("stream_cart_guard_as_of", lambda fx: streams.stream_cart_guard_as_of(fx.spark, feeds.stock_and_cart_feed(fx)))
_on_fixture("stream_order_status_audit", lambda fx: streams.stream_order_status_audit(
    fx.spark, feeds.order_status_events(fx)))
_on_fixture("stream_review_audit", lambda fx: streams.stream_review_audit(fx.spark, feeds.review_changes(fx)))
_on_fixture("stream_audit_table", lambda fx: streams.stream_audit_table(fx.spark, {
    "reviews": feeds.review_changes(fx), "products": _new_products(fx), "orders": feeds.order_status_events(fx)}))
_on_fixture("stream_daily_sales", lambda fx: streams.stream_daily_sales(fx.spark, _stream_lines(fx)))


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)
