"""Hand-made rows in the marketplace schema (S2), for tests.

A small household-goods shop of our own: an admin, two sellers, three customers, five categories and eight products, with
a few orders, a review and two carts that compete for the last travel mug.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import SparkSession

from souk.sources.schema import SCHEMAS
from souk.sources.tables import Tables

T0 = dt.datetime(2024, 1, 1, 9, 0, 0)


def _ts(days: int = 0, minutes: int = 0) -> dt.datetime:
    return T0 + dt.timedelta(days=days, minutes=minutes)


USERS = [
    (1, "Ada Admin", "ada@example.com", "admin", "active", _ts(0)),
    (2, "Carl Customer", "carl@example.com", "customer", "active", _ts(0)),
    (3, "Sam Seller", "sam@example.com", "seller", "active", _ts(1)),
    (4, "Sue Seller", "sue@example.com", "seller", "active", _ts(1)),
    (5, "Cleo Customer", "cleo@example.com", "customer", "active", _ts(2)),
    (6, "Cody Customer", "cody@example.com", "customer", "active", _ts(2)),
]
CATEGORIES = [(1, "Lamps"), (2, "Kettles"), (3, "Rugs"), (4, "Clocks"), (5, "Mugs")]
PRODUCTS = [
    (1, "Desk Lamp", "Reading lamp", "pics/lamp-a.png", D("27.30"), 6, 1, 4, _ts(3)),
    (2, "Copper Kettle", "Stove kettle", "/pics/kettle.png", D("112.45"), 3, 2, 3, _ts(3)),
    (3, "Floor Lamp", "Tall lamp", "", D("74.10"), 2, 1, 4, _ts(5)),
    (4, "Wool Rug", "Woven rug", "pics/rug.png", D("203.00"), 5, 3, 3, _ts(5)),
    (5, "Wall Clock", "Round clock", "pics/clock.png", D("18.62"), 40, 4, 4, _ts(5)),
    (6, "Travel Mug", "Steel mug", "pics/mug-a.png", D("13.90"), 1, 5, 4, _ts(8)),
    (7, "Tea Mug", "Clay mug", "pics/mug-b.png", D("6.25"), 120, 5, 3, _ts(8)),
    (8, "Glass Kettle", "Electric kettle", "pics/kettle-b.png", D("58.08"), 9, 2, 3, _ts(9)),
]
ORDERS = [
    (10001, 5, 1, "pending", _ts(10)),      # 2 x 27.30: subtotal 54.60, tax 2.73, total 67.33
    (10002, 5, 1, "completed", _ts(11)),    # 1 x 13.90: tax 0.695 -> 0.70, total 24.60
    (10003, 6, None, "pending", _ts(12)),   # no items
    (10004, 6, None, "cancelled", _ts(12)),  # cancelled, 1 x 203.00
]
ORDER_ITEMS = [
    (1, 10001, 1, 2, D("27.30")),
    (2, 10002, 6, 1, D("13.90")),
    (3, 10004, 4, 1, D("203.00")),
]
ADDRESSES = [(1, 5, "555 123 4567", "Town", "1 Main St", True, _ts(2)),
             (2, 5, "555 765 4321", "Town", "2 Side St", False, _ts(2))]
REVIEWS = [(1, 5, 6, 4, "Keeps warm", _ts(13))]
PAYMENTS = [(1, 10001, "card", "4242", "paid", _ts(10)), (2, 10002, "cash", None, "pending", _ts(11))]
INVOICES = [(1, 10001, "INV-10001", _ts(10))]
CART = [(1, 5, 6, 1), (2, 6, 6, 1), (3, 6, 2, 2)]  # users 5 and 6 both want the last unit of product 6


def seed_tables(spark: SparkSession) -> Tables:
    def df(name, rows):
        return spark.createDataFrame(rows, SCHEMAS[name])

    return Tables(users=df("users", USERS), user_addresses=df("user_addresses", ADDRESSES),
                  categories=df("categories", CATEGORIES), products=df("products", PRODUCTS),
                  cart=df("cart", CART), orders=df("orders", ORDERS), order_items=df("order_items", ORDER_ITEMS),
                  reviews=df("reviews", REVIEWS), payments=df("payments", PAYMENTS),
                  invoices=df("invoices", INVOICES))
