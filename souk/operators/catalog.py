"""Catalog jobs: product views, search, seller catalog, display derivations,
and the catalog feed load (P1, P8, P9, J1, J2, S3, S4)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.money import DEFAULT_IMAGE
from souk.functions.text import name_key, php_trim
from souk.operators.reports import rating_summary, review_aggregates
from souk.plans.trigrams import candidates
from souk.sources.tables import Tables, conform

AVG_SCALE = 4  # AVG over INT columns reports four decimals in the reference database.


def _cat_names(t: Tables) -> DataFrame:
    return t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))


def _seller_names(t: Tables) -> DataFrame:
    return t.users.select(F.col("id").alias("seller_id"), F.col("name").alias("seller_name"))


def live_average(sum_col: str, count_col: str, scale: int = AVG_SCALE) -> Column:
    """COALESCE(AVG(rating), 0) at the database's four-decimal scale, half up, exact."""
    unit = 10 ** scale
    q = F.expr(f"(2 * {unit} * cast(coalesce({sum_col}, 0) as decimal(38,0)) + coalesce({count_col}, 0)) "
               f"div (2 * coalesce({count_col}, 0))")
    typ = f"decimal({scale + 1},{scale})"
    return F.when(F.expr(f"coalesce({count_col}, 0)") > 0, (q.cast("decimal(38,0)") / F.lit(unit)).cast(typ)) \
            .otherwise(F.lit(0).cast(typ))


def product_catalog(t: Tables) -> DataFrame:
    """J1. Products with their category name (inner join: products of missing categories drop)."""
    return t.products.join(_cat_names(t), "category_id").select(
        "id", "name", "description", "image_url", "price", "stock", "category_name")


def product_catalog_full(t: Tables) -> DataFrame:
    """J2. J1 plus seller name and the stored rating summary (zeros when absent)."""
    summary = t.extras.get("rating_summary")
    if summary is None:
        summary = rating_summary(t)
    base = t.products.join(_cat_names(t), "category_id").join(_seller_names(t), "seller_id")
    joined = base.join(summary.withColumnRenamed("product_id", "id"), "id", "left")
    return joined.select(
        "id", "name", "description", "image_url", "price", "stock", "category_name", "seller_name",
        F.coalesce("average_rating", F.lit(0).cast("decimal(3,2)")).alias("average_rating"),
        F.coalesce("review_count", F.lit(0).cast("bigint")).alias("review_count"))


def _with_live_rating(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Attach the live average rating; reviews are aggregated per product before the join."""
    agg = review_aggregates(reviews).select(F.col("product_id").alias("id"), "rated_count", "rating_sum")
    return products.join(agg, "id", "left").withColumn("avg_rating", live_average("rating_sum", "rated_count")) \
                   .drop("rated_count", "rating_sum")


def like_text(pattern: str) -> str:
    """A LIKE pattern as the database reads it: a backslash before anything but a wildcard or a backslash stands for
    nothing, one at the end for itself."""
    kept = re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], pattern, flags=re.DOTALL)
    loose = len(kept) - len(kept.rstrip("\\"))
    return kept + "\\" if loose % 2 else kept


def catalog_search(t: Tables, search: str = "", category_id: int = 0,
                   accent_insensitive: bool = False, grams: DataFrame | None = None) -> DataFrame:
    """P1. Optional case-insensitive name search and optional category, newest first.

    Filters are added only when their argument is set, so the plan holds only
    the predicates that matter. With the default matcher ``%`` and ``_`` in
    the search text act as wildcards, as with the reference's LIKE; with
    ``accent_insensitive=True`` the text is matched literally under an
    accent- and case-insensitive collation. ``grams`` is a trigram table of the
    product names (``plans.trigrams``): names that cannot match are left out by a
    join before the exact match; a search without three literal characters in
    a row, or under the collation, reads all names.
    """
    search = (search or "").strip()
    p = t.products
    if search:
        if accent_insensitive:
            p = p.filter(F.contains(F.col("name").cast("string collate UNICODE_CI_AI"), F.lit(search)))
        else:
            pattern = like_text(f"%{search}%")
            possible = None if grams is None else candidates(grams, pattern)
            if possible is not None:
                p = p.join(possible, "id", "left_semi")
            p = p.filter(F.col("name").ilike(pattern))
    if category_id:
        p = p.filter(F.col("category_id") == category_id)
    base = p.join(_cat_names(t), "category_id").join(_seller_names(t), "seller_id")
    out = _with_live_rating(base, t.reviews)
    return out.select("id", "name", "description", "price", "stock", "image_url", "category_name",
                      "seller_name", "avg_rating", "created_at") \
              .orderBy(F.desc("created_at"), "id")


def seller_catalog(t: Tables, seller_id: int | None = None) -> DataFrame:
    """P8. Each seller's products with category and live average rating (all sellers by default)."""
    p = t.products if seller_id is None else t.products.filter(F.col("seller_id") == seller_id)
    base = p.join(_cat_names(t), "category_id")
    out = _with_live_rating(base, t.reviews)
    return out.select("id", "name", "description", "image_url", "price", "stock", "category_id", "category_name",
                      "seller_id", "created_at", "avg_rating") \
              .orderBy("seller_id", F.desc("created_at"), "id")


def catalog_card(df: DataFrame) -> DataFrame:
    """P9. Display fields: fallback image, leading '/' stripped, stock flag, rating to one place."""
    img = F.when(F.coalesce(F.col("image_url"), F.lit("")).isin("", "0"), F.lit(DEFAULT_IMAGE)) \
           .otherwise(F.col("image_url"))
    return df.select(
        "id", "name", "category_name", "seller_name", "price", "stock",
        F.regexp_replace(img, "^/+", "").alias("image_path"),
        (F.col("stock") > 0).alias("in_stock"),
        F.round(F.col("avg_rating"), 1).cast("decimal(2,1)").alias("rating_display"))


def load_catalog_feed(feed: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3. Resolve category by name, whatever its case, accents and trailing blanks. Unmatched rows are dropped by the load and
    returned separately as rejects."""
    cats = categories.select(F.col("id").alias("category_id"), name_key(F.col("name")).alias("__name"))
    named = feed.withColumn("__name", name_key(F.col("category_name")))
    loaded = named.join(cats, "__name").drop("__name")
    rejected = named.join(cats, "__name", "left_anti").drop("__name").withColumn("reason", F.lit("unknown category"))
    return loaded, rejected


def reload_catalog(t: Tables, feed: DataFrame, as_of=None) -> Tables:
    """S4. Full catalog reload: dependants emptied child first, products replaced by the feed.

    New product ids follow the feed's ``seq`` order (ids 1..n); this is a
    replacement, so nothing else keeps old product ids.
    """
    import datetime as dt

    from souk.functions.text import ts_literal
    from souk.plans.numbering import number_rows

    loaded, _ = load_catalog_feed(feed, t.categories)
    numbered = number_rows(loaded, "seq", "id", start=1)
    stamp = ts_literal(as_of or dt.datetime(2000, 1, 1))
    products = conform(numbered.withColumn("name", php_trim(F.col("name"))).withColumn("created_at", stamp),
                       "products")
    empty = {name: df.limit(0) for name, df in t.items()
             if name in ("reviews", "cart", "invoices", "payments", "order_items", "orders")}
    return t.with_(products=products, **empty)
