"""Map the driver's synthetic tables onto the marketplace schema.

The same mapping is written as DuckDB CTE text in ``souk.oracle.fixtures_sql``;
both must change together. Every table is derived lazily from the parquet
scans, so column pruning and filter pushdown reach the files.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.plans.tasks import dealt
from souk.sources.tables import Tables, conform

# Fixed values of the test-data mapping.
SELLER_ID_BASE = 1_000_000_000
EPOCH = dt.date(1995, 1, 1)
UNLISTED_CATEGORY = "UNLISTED"
CARD_BASE = 4_000_000_000_000_000
PHONE_PREFIX = "55501"


def days_after_epoch(n: Column) -> Column:
    return F.date_add(F.lit(EPOCH), n.cast("int")).cast("timestamp_ntz")


def email_from_name(name: Column) -> Column:
    return F.concat(F.lower(F.translate(name, "#", ".")), F.lit("@example.com"))


def phone_text(custkey: Column) -> Column:
    """8 + key % 9 digits, written with a space and a dash between groups."""
    digits = F.concat(F.lit(PHONE_PREFIX), F.lpad(custkey.cast("string"), 11, "0"))
    d = F.substring(digits, F.lit(1), (F.lit(8) + custkey % 9).cast("int"))
    return F.concat(F.substring(d, 1, 3), F.lit(" "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 100))


def card_text(custkey: Column) -> Column:
    return (F.lit(CARD_BASE) + custkey * 7).cast("string")


class Fixture:
    """Lazily built marketplace tables and change feeds for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    def raw(self, name: str) -> DataFrame:
        """The scan of one driver table; the plan, not data, is kept with this Fixture."""
        return self._get(f"raw {name}", lambda: self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))

    def rows(self, name: str) -> int:
        """Number of rows of one driver table, from the footers of its files."""
        return self._get(f"rows {name}", lambda: self.raw(name).count())

    def bounds(self) -> dict:
        """At most so many rows of each table, without deriving it."""
        of = {"users": ("customer", "supplier"), "user_addresses": ("customer", "customer"), "categories": ("part",), "products": ("part",),
              "cart": ("lineitem",), "orders": ("orders",), "order_items": ("lineitem",), "reviews": ("lineitem",), "payments": ("orders",),
              "invoices": ("orders",)}
        return {table: lambda raw=raw: sum(map(self.rows, raw)) for table, raw in of.items()}

    # ---- base tables -------------------------------------------------
    def users(self) -> DataFrame:
        def build():
            c = self.raw("customer")
            s = self.raw("supplier")
            customers = c.select(
                F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                email_from_name(F.col("c_name")).alias("email"), F.lit("customer").alias("role"),
                F.when(F.col("c_acctbal") < 0, "suspended").otherwise("active").alias("account_status"),
                days_after_epoch(F.col("c_custkey") % 1000).alias("created_at"))
            sellers = s.select(
                (F.lit(SELLER_ID_BASE) + F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"),
                email_from_name(F.col("s_name")).alias("email"), F.lit("seller").alias("role"),
                F.lit("active").alias("account_status"),
                days_after_epoch(F.col("s_suppkey") % 1000).alias("created_at"))
            return conform(customers.unionByName(sellers), "users")
        return self._get("users", build)

    def categories(self) -> DataFrame:
        def build():
            # Distinct types are a small dimension; numbering them needs one ordered pass.
            types = self.raw("part").select(F.col("p_type").alias("name")).distinct()
            numbered = types.select(F.dense_rank().over(Window.orderBy("name")).alias("id"), "name")
            unlisted = self.spark.range(1).select(F.lit(0).alias("id"), F.lit(UNLISTED_CATEGORY).alias("name"))
            return conform(numbered.unionByName(unlisted), "categories")
        return self._get("categories", build)

    def supplier_count(self) -> Column:
        return self.raw("supplier").select(F.count(F.lit(1))).scalar()

    def part_count(self) -> Column:
        return self.raw("part").select(F.count(F.lit(1))).scalar()

    def product_columns(self, part: DataFrame) -> DataFrame:
        """Product attributes from part rows; category resolved later by type name."""
        key = F.col("p_partkey")
        return part.select(
            key.alias("id"), F.col("p_name").alias("name"),
            F.concat_ws(" ", "p_brand", "p_type", F.lit("size"), F.col("p_size").cast("string")).alias("description"),
            F.when(F.col("p_size") % 7 == 0, F.lit(""))
             .when(F.col("p_size") % 5 == 0, F.concat(F.lit("/img/"), key.cast("string"), F.lit(".jpg")))
             .otherwise(F.concat(F.lit("img/"), key.cast("string"), F.lit(".jpg"))).alias("image_url"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
            F.when(key % 25 == 0, F.lit(0)).otherwise(F.lit(20) + (key * 37) % 381).cast("int").alias("stock"),
            F.col("p_type").alias("category_name"),
            (F.lit(SELLER_ID_BASE) + key % (self.supplier_count() - 1)).alias("seller_id"),
            days_after_epoch(key % 500).alias("created_at"))

    def products(self) -> DataFrame:
        def build():
            cols = self.product_columns(self.raw("part"))
            cats = self.categories().select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
            return conform(cols.join(cats, "category_name"), "products")
        return self._get("products", build)

    def orders(self) -> DataFrame:
        def build():
            o = self.raw("orders")
            st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
            status = (F.when((st == "P") & (pr == "5-LOW"), "cancelled").when(st == "P", "pending")
                      .when(st == "O", "completed").when(st == "F", "delivered"))
            return conform(o.select(
                F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey") * 2).alias("delivery_address_id"),
                status.alias("status"), F.col("o_orderdate").alias("created_at")), "orders")
        return self._get("orders", build)

    def order_items(self) -> DataFrame:
        def build():
            # Hash-partition by order once: the (order, part) grouping and every later
            # per-order aggregation or join on order_id reuse this partitioning.
            # The number of partitions follows the rows, so that a task's memory does not grow with the table.
            li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
            li = dealt(li, self.rows("lineitem"), "l_orderkey")
            g = li.groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id")).agg(
                F.floor(F.sum("l_quantity")).cast("int").alias("quantity"),
                F.min(F.col("l_extendedprice").cast("decimal(10,2)")).alias("price"))
            return conform(g.withColumn("id", F.col("order_id") * 1_000_000 + F.col("product_id")), "order_items")
        return self._get("order_items", build)

    def user_addresses(self) -> DataFrame:
        def build():
            c = self.raw("customer").join(
                self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
            k = F.col("c_custkey")
            common = [k.alias("user_id"), phone_text(k).alias("phone"), F.col("n_name").alias("city"),
                      F.concat(F.lit("Street "), k.cast("string")).alias("address"),
                      days_after_epoch(k % 1000).alias("created_at")]
            first = c.filter(k % 10 != 0).select((k * 2).alias("id"), (k % 3 != 0).alias("is_default"), *common)
            second = c.filter(k % 4 == 0).select((k * 2 + 1).alias("id"), (k % 8 == 0).alias("is_default"), *common)
            return conform(first.unionByName(second), "user_addresses")
        return self._get("user_addresses", build)

    def payments(self) -> DataFrame:
        def build():
            o = self.raw("orders").filter(F.col("o_orderkey") % 20 != 19)
            card = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
            return conform(o.select(
                F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("order_id"),
                F.when(card, "card").otherwise("cash").alias("payment_method"),
                F.when(card, F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")).alias("card_last4"),
                F.when(card, "paid").otherwise("pending").alias("payment_status"),
                F.col("o_orderdate").alias("created_at")), "payments")
        return self._get("payments", build)

    def invoices(self) -> DataFrame:
        def build():
            from souk.functions.money import invoice_number
            o = self.raw("orders").filter(F.col("o_orderkey") % 25 != 24)
            return conform(o.select(
                F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("order_id"),
                invoice_number(F.col("o_orderkey")).alias("invoice_number"),
                F.col("o_orderdate").alias("issued_at")), "invoices")
        return self._get("invoices", build)

    def reviews(self) -> DataFrame:
        def build():
            delivered = self.orders().filter(F.col("status") == "delivered").select(
                F.col("id").alias("order_id"), "user_id", "created_at")
            items = self.order_items().filter((F.col("order_id") * 31 + F.col("product_id")) % 3 == 0)
            first = (items.join(delivered, "order_id")
                     .groupBy("user_id", "product_id")
                     .agg(F.min(F.struct("order_id", "created_at")).alias("o")))
            oid, pid = F.col("o.order_id"), F.col("product_id")
            return conform(first.select(
                (oid * 1_000_000 + pid).alias("id"), "user_id", "product_id",
                (F.lit(1) + (oid + pid) % 5).cast("int").alias("rating"),
                F.concat(F.lit("Review of product "), pid.cast("string")).alias("comment"),
                (F.col("o.created_at") + F.expr("INTERVAL 7 DAYS")).alias("created_at")), "reviews")
        return self._get("reviews", build)

    def cart(self) -> DataFrame:
        def build():
            last_pending = (self.orders().filter(F.col("status") == "pending")
                            .groupBy("user_id").agg(F.max("id").alias("order_id")))
            lines = self.order_items().join(last_pending.hint("merge"), "order_id")  # a row a user
            return conform(lines.select(
                (F.col("order_id") * 1_000_000 + F.col("product_id")).alias("id"),
                "user_id", "product_id", "quantity"), "cart")
        return self._get("cart", build)

    def tables(self) -> Tables:
        if "tables" not in self._cache:
            self._cache["tables"] = Tables(
                users=self.users, user_addresses=self.user_addresses, categories=self.categories,
                products=self.products, cart=self.cart, orders=self.orders, order_items=self.order_items,
                reviews=self.reviews, payments=self.payments, invoices=self.invoices,
                extras={"fixture": self, "rows": self.bounds()})
        return self._cache["tables"]


def load_fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Fixture(spark, sf_dir).tables()
