"""Plan helpers, typed loading, views and the schema check."""

import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from souk.operators import quality, reports
from souk.plans.numbering import previous_values
from souk.sources.tables import load_tables, register_views, write_tables


def test_previous_values_match_pandas_with_hot_key(spark):
    rng = random.Random(3)
    rows = [(i, 0 if rng.random() < 0.5 else rng.randint(1, 20), rng.choice("abc")) for i in range(2000)]
    df = spark.createDataFrame(rows, "seq long, k long, v string")
    got = {r["seq"]: r["prev_v"] for r in previous_values(df, ["k"], ["seq"], ["v"], buckets=16).collect()}
    pdf = pd.DataFrame(rows, columns=["seq", "k", "v"]).sort_values("seq")
    pdf["p"] = pdf.groupby("k")["v"].shift(1)
    exp = {s: (None if pd.isna(p) else p) for s, p in zip(pdf["seq"], pdf["p"])}
    assert got == exp


def test_write_load_roundtrip_and_views(spark, seed):
    path = tempfile.mkdtemp(prefix="souk-tables-") + "/t"
    write_tables(seed, path)
    loaded = load_tables(spark, path)
    assert [(f.name, f.dataType) for f in loaded.products.schema] == [(f.name, f.dataType) for f in seed.products.schema]
    assert sorted(loaded.orders.collect()) == sorted(seed.orders.collect())
    register_views(spark, loaded)
    got = spark.sql("SELECT sum(total_amount) AS s FROM order_totals_view").collect()[0]["s"]
    assert got == reports.order_totals(seed).agg(F.sum("total_amount")).collect()[0][0]
    assert spark.sql("SELECT count(*) FROM product_catalog_full_view").collect()[0][0] == 8


def test_load_drops_password_and_retired_columns(spark, seed):
    path = tempfile.mkdtemp(prefix="souk-legacy-") + "/t"
    write_tables(seed, path)
    legacy_users = seed.users.withColumn("password", F.lit("x"))
    legacy_users.write.mode("overwrite").parquet(path + "/users")
    loaded = load_tables(spark, path)
    assert "password" not in loaded.users.columns
    problems = quality.check_schema({"users": legacy_users, "orders": seed.orders.withColumn(
        "total_amount", F.lit(1)), "payments": seed.payments.drop("card_last4")})
    assert ("users", "password", "retired") in problems
    assert ("orders", "total_amount", "retired") in problems
    assert ("payments", "card_last4", "missing") in problems


def test_load_reads_by_the_declared_schema(spark, seed):
    path = tempfile.mkdtemp(prefix="souk-typed-") + "/t"
    write_tables(seed, path)
    seed.payments.drop("card_last4").write.mode("overwrite").parquet(path + "/payments")
    seed.products.withColumn("price", F.concat("price", F.lit(" EUR"))).write.mode("overwrite").parquet(path + "/products")
    loaded = load_tables(spark, path)
    assert loaded.payments.columns == seed.payments.columns
    assert loaded.payments.filter("card_last4 IS NOT NULL").count() == 0 < loaded.payments.count()
    assert loaded.products.select("id").count() == seed.products.count()
    with pytest.raises(Exception, match="(?i)column.*price"):
        loaded.products.collect()


def test_schema_check_types(seed):
    bad = seed.products.withColumn("price", F.col("price").cast("double"))
    assert quality.check_schema({"products": bad}) == [("products", "price", "type double != decimal(10,2)")]


def test_contacts_checks(spark):
    df = spark.createDataFrame([
        (1, "a.b@example.com", "555 123-4567", "4539 1488 0343 6467"),
        (2, "no-at.example.com", "123", "4539148803436468"),
        (3, "x" * 95 + "@e.com", "+1 (555) 123 4567 89", ""),
    ], "user_id long, email string, phone string, card_number string")
    got = {r["user_id"]: (r["email_ok"], r["phone_ok"], r["card_ok"]) for r in quality.check_contacts(df).collect()}
    assert got == {1: (True, True, True), 2: (False, False, False), 3: (False, True, False)}


def test_append_audit_sink(spark, fx):
    from souk.operators import audit
    from souk.sources import feeds
    path = tempfile.mkdtemp(prefix="souk-audit-") + "/audit_log"
    rows = audit.review_audit(feeds.review_changes(fx))
    n1 = audit.append_audit(rows.filter("action_type = 'INSERT'"), path)
    n2 = audit.append_audit(rows.filter("action_type = 'DELETE'"), path)
    log = spark.read.parquet(path)
    ids = sorted(r["id"] for r in log.select("id").collect())
    assert ids == list(range(1, n1 + n2 + 1))
    first_delete = log.filter("action_type = 'DELETE'").agg(F.min("id")).collect()[0][0]
    assert first_delete == n1 + 1
