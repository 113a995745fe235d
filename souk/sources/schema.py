"""Marketplace table schemas, allowed ENUM values and the money type.

Passwords and reset tokens are never part of any schema here.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Allowed ENUM members, in declaration order.
USER_ROLES = ("admin", "seller", "customer")
ACCOUNT_STATUSES = ("pending", "active", "suspended")
ORDER_STATUSES = ("pending", "completed", "delivered", "cancelled")
PAYMENT_METHODS = ("card", "cash")
PAYMENT_STATUSES = ("pending", "paid")

# Money read from tables keeps the column type; computed money is widened to
# decimal(38,2) so store-wide sums cannot overflow at any scale.
PRICE = T.DecimalType(10, 2)
MONEY = T.DecimalType(38, 2)
RATING = T.DecimalType(3, 2)

L, I, S, B, TS, D = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.TimestampNTZType(), PRICE


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SCHEMAS: dict[str, T.StructType] = {
    "users": _struct(("id", L, False), ("name", S, False), ("email", S, False), ("role", S, True),
                     ("account_status", S, True), ("created_at", TS, True)),
    "user_addresses": _struct(("id", L, False), ("user_id", L, False), ("phone", S, True), ("city", S, True),
                              ("address", S, False), ("is_default", B, True), ("created_at", TS, True)),
    "categories": _struct(("id", L, False), ("name", S, False)),
    "products": _struct(("id", L, False), ("name", S, False), ("description", S, True), ("image_url", S, True),
                        ("price", D, False), ("stock", I, True), ("category_id", L, False),
                        ("seller_id", L, False), ("created_at", TS, True)),
    "cart": _struct(("id", L, False), ("user_id", L, False), ("product_id", L, False), ("quantity", I, False)),
    "orders": _struct(("id", L, False), ("user_id", L, False), ("delivery_address_id", L, True),
                      ("status", S, True), ("created_at", TS, True)),
    "order_items": _struct(("id", L, False), ("order_id", L, False), ("product_id", L, False),
                           ("quantity", I, False), ("price", D, False)),
    "reviews": _struct(("id", L, False), ("user_id", L, False), ("product_id", L, False), ("rating", I, True),
                       ("comment", S, True), ("created_at", TS, True)),
    "payments": _struct(("id", L, False), ("order_id", L, False), ("payment_method", S, True),
                        ("card_last4", S, True), ("payment_status", S, True), ("created_at", TS, True)),
    "invoices": _struct(("id", L, False), ("order_id", L, False), ("invoice_number", S, False),
                        ("issued_at", TS, True)),
    "product_rating_summary": _struct(("product_id", L, False), ("review_count", L, False),
                                      ("average_rating", RATING, False)),
    "audit_log": _struct(("id", L, True), ("table_name", S, False), ("action_type", S, False),
                         ("record_id", L, True), ("details", S, True), ("created_at", TS, True)),
}

TABLE_NAMES = ("users", "user_addresses", "categories", "products", "cart", "orders", "order_items",
               "reviews", "payments", "invoices")

# The foreign keys as (child, column, parent, what a delete of the parent does to the child).
CASCADE, SET_NULL = "cascade", "set null"
FOREIGN_KEYS = (
    ("user_addresses", "user_id", "users", CASCADE),
    ("products", "category_id", "categories", CASCADE),
    ("products", "seller_id", "users", CASCADE),
    ("cart", "user_id", "users", CASCADE),
    ("cart", "product_id", "products", CASCADE),
    ("orders", "user_id", "users", CASCADE),
    ("orders", "delivery_address_id", "user_addresses", SET_NULL),
    ("order_items", "order_id", "orders", CASCADE),
    ("order_items", "product_id", "products", CASCADE),
    ("reviews", "user_id", "users", CASCADE),
    ("reviews", "product_id", "products", CASCADE),
    ("payments", "order_id", "orders", CASCADE),
    ("invoices", "order_id", "orders", CASCADE),
)
#: The key of the stored rating summary, which goes with its product.
SUMMARY_KEY = "product_id"

# Columns the schema migrations dropped; a load that still carries them is
# reported by the schema check and the columns are discarded.
RETIRED_COLUMNS = {
    "orders": ("subtotal", "delivery_fee", "tax_amount", "total_amount", "payment_method", "card_last4"),
    "payments": ("amount",),
    "users": ("password",),
}
