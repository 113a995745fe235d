"""Row order of the listings (L1-L4): every ORDER BY ends with the id."""

import pytest

from souk.operators import catalog, listings, reports, reviews

NEWEST = [("created_at", True), ("id", False)]
CASES = {
    "users": (lambda t: listings.user_listing(t), NEWEST),
    "categories": (lambda t: listings.category_listing(t), [("name", False), ("id", False)]),
    "cart": (lambda t: listings.cart_lines(t), [("user_id", False), ("id", True)]),
    "history": (lambda t: listings.order_history(t), [("user_id", False), *NEWEST]),
    "admin orders": (lambda t: listings.admin_order_listing(t), NEWEST),
    "admin products": (lambda t: listings.admin_product_listing(t), NEWEST),
    "admin reviews": (lambda t: listings.admin_review_listing(t), NEWEST),
    "search": (lambda t: catalog.catalog_search(t), NEWEST),
    "seller catalog": (lambda t: catalog.seller_catalog(t), [("seller_id", False), *NEWEST]),
    "user reviews": (lambda t: reviews.user_reviews(t), [("user_id", False), *NEWEST]),
    "reviewable": (lambda t: reviews.reviewable_products(t), [("user_id", False), ("name", False), ("product_id", False)]),
    "top products": (lambda t: reports.top_products(t), [("units_sold", True), ("product_id", False)]),
    "seller revenue": (lambda t: reports.seller_revenue(t), [("seller_revenue", True), ("seller_id", False)]),
    "category revenue": (lambda t: reports.category_revenue(t), [("revenue", True), ("category_id", False)]),
    "category counts": (lambda t: reports.category_product_counts(t), [("name", False), ("id", False)]),
}


@pytest.mark.parametrize("name", CASES)
def test_rows_come_in_order(fx, name):
    build, order = CASES[name]
    rows = build(fx.tables()).collect()
    want = list(rows)
    for col, descending in reversed(order):  # stable sorts, least significant column first
        want.sort(key=lambda r: r[col], reverse=descending)
    assert len(rows) > 5 and rows == want
