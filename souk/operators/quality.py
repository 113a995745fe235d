"""Table-wide data-quality checks: the schema's CHECK, UNIQUE and FOREIGN KEY
constraints and the form validators, re-aimed as jobs returning violating rows
(D1-D5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.text import email_valid, luhn_valid, name_key, phone_valid
from souk.plans.tasks import looked_up, spread
from souk.sources.schema import (ACCOUNT_STATUSES, FOREIGN_KEYS, ORDER_STATUSES, PAYMENT_METHODS, PAYMENT_STATUSES,
                                 SCHEMAS, USER_ROLES)
from souk.sources.tables import Tables, retired_columns_present


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _violations(df: DataFrame, table: str, rule: str, passes: Column) -> DataFrame:
    # A CHECK passes on NULL: only a rule that evaluates to false is a violation.
    return df.filter(passes == F.lit(False)).select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.col("id").cast("bigint").alias("record_id"))


def _not_null(df: DataFrame, table: str, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull()).select(
        F.lit(table).alias("table_name"), F.lit(f"{col} not null").alias("rule"),
        F.col("id").cast("bigint").alias("record_id"))


def check_rows(t: Tables) -> DataFrame:
    """D1. Row-level CHECK / ENUM / NOT NULL rules; one output row per violation."""
    u, c, o, oi, r, p = t.users, t.cart, t.orders, t.order_items, t.reviews, t.payments
    parts = [
        _violations(u, "users", "email length 5-100", F.length("email").between(5, 100)),
        _violations(u, "users", "role allowed", F.col("role").isin(*USER_ROLES)),
        _violations(u, "users", "account_status allowed", F.col("account_status").isin(*ACCOUNT_STATUSES)),
        _not_null(u, "users", "name"), _not_null(u, "users", "email"),
        _violations(c, "cart", "quantity > 0", F.col("quantity") > 0),
        _violations(o, "orders", "status allowed", F.col("status").isin(*ORDER_STATUSES)),
        _violations(oi, "order_items", "quantity > 0", F.col("quantity") > 0),
        _not_null(oi, "order_items", "price"),
        _violations(r, "reviews", "rating 1-5", F.col("rating").between(1, 5)),
        _violations(p, "payments", "card_last4 4 chars",
                    F.col("card_last4").isNull() | (F.length("card_last4") == 4)),
        _violations(p, "payments", "payment_method allowed", F.col("payment_method").isin(*PAYMENT_METHODS)),
        _violations(p, "payments", "payment_status allowed", F.col("payment_status").isin(*PAYMENT_STATUSES)),
        _not_null(t.products, "products", "name"), _not_null(t.products, "products", "price"),
    ]
    return _union(parts)


def check_contacts(df: DataFrame) -> DataFrame:
    """D2. Email shape and length, phone 10-15 digits, card 13-19 digits with a valid checksum.

    All three are native column expressions (the checksum uses higher-order
    array functions), so the check stays inside whole-stage code generation.
    """
    return df.select("user_id", email_valid(F.col("email")).alias("email_ok"),
                     phone_valid(F.col("phone")).alias("phone_ok"),
                     luhn_valid(F.col("card_number")).alias("card_ok"))


UNIQUE_KEYS = (
    ("users", ("lower(email)",)),
    ("categories", ("lower(name)",)),
    ("cart", ("user_id", "product_id")),
    ("order_items", ("order_id", "product_id")),
    ("reviews", ("user_id", "product_id")),
    ("reviews", ("id",)),
    ("payments", ("order_id",)),
    ("invoices", ("order_id",)),
    ("invoices", ("invoice_number",)),
)


def check_unique(t: Tables) -> DataFrame:
    """D3. Keys that occur more than once; a key with a NULL never does.

    Email and category name compare as names do (``name_key``); of several spellings the least is shown, in lower case."""
    tables = dict(t.items())
    parts = []
    for table, keys in UNIQUE_KEYS:
        typed = [F.expr(k).alias(f"k{i}") for i, k in enumerate(keys)]
        names = [f"k{i}" for i in range(len(keys))]
        rows = tables[table].select(*typed).dropna(subset=names)
        if keys[0].startswith("lower("):
            named = spread(rows.select(name_key(F.col("k0")).alias("name"), "k0"), t.rows(table), "name")
            g = named.groupBy("name").agg(F.min("k0").alias("k0"), F.count(F.lit(1)).alias("occurrences"))
        else:
            g = spread(rows, t.rows(table), *names).groupBy(*names).agg(F.count(F.lit(1)).alias("occurrences"))
        parts.append(g.filter("occurrences > 1").select(
            F.lit(table).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"),
            F.concat_ws("|", *[F.col(n).cast("string") for n in names]).alias("key_value"), "occurrences"))
    return _union(parts)


def check_references(t: Tables) -> DataFrame:
    """D4. Child rows whose (non-NULL) foreign key has no parent row."""
    tables = dict(t.items())
    parts = []
    for child, col, parent, _ in FOREIGN_KEYS:
        keys = tables[parent].select(F.col("id").alias(col))
        orphans = looked_up(tables[child].filter(F.col(col).isNotNull()), keys, col, "left_anti", t.rows(child), t.rows(parent))
        parts.append(orphans.select(F.lit(child).alias("table_name"), F.lit(col).alias("column_name"),
                                    F.col("id").cast("bigint").alias("record_id"),
                                    F.col(col).cast("bigint").alias("missing_key")))
    return _union(parts)


def check_schema(frames: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """D5. Compare loaded frames with the declared schemas (metadata only, no job).

    Returns (table, column, problem) for missing, retired, unexpected or
    differently typed columns.
    """
    out = []
    for name, df in frames.items():
        expected = {f.name: f.dataType for f in SCHEMAS[name].fields}
        actual = {f.name: f.dataType for f in df.schema.fields}
        for col in expected:
            if col not in actual:
                out.append((name, col, "missing"))
            elif actual[col] != expected[col]:
                out.append((name, col, f"type {actual[col].simpleString()} != {expected[col].simpleString()}"))
        retired = set(retired_columns_present(df, name))
        for col in actual:
            if col in retired:
                out.append((name, col, "retired"))
            elif col not in expected:
                out.append((name, col, "unexpected"))
    return out
