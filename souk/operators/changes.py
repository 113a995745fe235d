"""Bulk change jobs (M1, M2, M2b, M3, M6-M8, M10; M9 is in ``cascades``).

The reference edits one row per web request. Here each job takes a change
feed DataFrame (ordered by ``seq``) and returns the new table state, plus
the rejected rows with a ``reason`` where the reference would show an error.
Nothing is updated in place: callers write the returned state to a new
location and switch to it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.text import collapse_ws, fits_int, name_key, php_int, php_trim, phone_valid, ts_literal
from souk.plans.numbering import number_rows, order_bucket
from souk.plans.scans import LIMIT, Pieces, compose_runs, states_before
from souk.session import written
from souk.sources.schema import ACCOUNT_STATUSES, ORDER_STATUSES, USER_ROLES
from souk.sources.tables import Tables, conform

# The reference's form messages.
MSG_FIELDS = "Please fill in all product fields correctly."
MSG_NO_CATEGORY = "Selected category does not exist."
MSG_NOT_FOUND = "Product not found."
MSG_ID_TAKEN = "Product id is already assigned."  # the bulk job's own: a database would assign the id
MSG_STOCK = "Requested quantity is more than available stock."
MSG_NO_CART_ITEM = "Cart item not found."
MSG_ADDRESS = "Please enter your complete delivery address."
MSG_PHONE = "Please enter a valid phone number."
DEFAULT_AS_OF = dt.datetime(2000, 1, 1)


def last_per_key(feed: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Keep the latest change per key by ``seq`` with a max-of-struct aggregation.

    Partial aggregation keeps this safe when one key has very many changes.
    """
    others = [c for c in feed.columns if c not in keys and c != seq]
    agg = feed.groupBy(*keys).agg(F.max(F.struct(F.col(seq), *others)).alias("__last"))
    return agg.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in [seq] + others])


def upsert(base: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """M2. INSERT ... ON DUPLICATE KEY UPDATE: rows of ``updates`` replace or add.

    The side is chosen by a presence marker, so an update that sets a column
    to NULL is kept (a coalesce would lose it).
    """
    cols = [c for c in base.columns if c not in key]
    b = base.select(*key, *[F.col(c).alias(f"__b_{c}") for c in cols], F.lit(True).alias("__in_b"))
    u = updates.select(*key, *[F.col(c).alias(f"__u_{c}") for c in cols], F.lit(True).alias("__in_u"))
    j = b.join(u, key, "full_outer")
    return j.select(*key, *[F.when(F.col("__in_u"), F.col(f"__u_{c}")).otherwise(F.col(f"__b_{c}")).alias(c)
                            for c in cols]).select(*base.columns)


def insert_ignore_categories(categories: DataFrame, feed: DataFrame) -> DataFrame:
    """M2b. Add new category names (``seq``, ``name``): an existing name wins whatever its case or accents, blanks are skipped.

    Of spellings that are one name to the database the first to arrive is kept; new ids continue after the current maximum in
    order of arrival.
    """
    names = feed.select("seq", php_trim(F.col("name")).alias("name")).filter(F.col("name") != "")
    first = names.groupBy(name_key(F.col("name")).alias("k")).agg(F.min(F.struct("seq", "name")).alias("f"))
    new = first.join(categories.select(name_key(F.col("name")).alias("k")), "k", "left_anti").select("f.seq", "f.name")
    start = categories.select(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()
    return categories.unionByName(conform(number_rows(new, "seq", "id", start=start), "categories"))


def mark_delivered(orders: DataFrame, as_of: dt.datetime = DEFAULT_AS_OF) -> DataFrame:
    """M6. Pending or completed orders at least one minute old at ``as_of`` become delivered."""
    cutoff = ts_literal(as_of) - F.expr("INTERVAL 1 MINUTE")
    due = F.col("status").isin("pending", "completed") & (F.col("created_at") <= cutoff)
    return orders.withColumn("status", F.when(due, F.lit("delivered")).otherwise(F.col("status")))


def _member_or(c: Column, allowed: tuple, default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def apply_user_changes(users: DataFrame, feed: DataFrame) -> DataFrame:
    """M7. Role / status changes; unknown role -> customer, unknown status -> active."""
    ch = feed.select("seq", "user_id",
                     _member_or(F.col("role"), USER_ROLES, "customer").alias("new_role"),
                     _member_or(F.col("account_status"), ACCOUNT_STATUSES, "active").alias("new_status"))
    last = last_per_key(ch, ["user_id"]).withColumnRenamed("user_id", "id")
    j = users.join(last.drop("seq"), "id", "left")
    return j.select("id", "name", "email",
                    F.coalesce("new_role", "role").alias("role"),
                    F.when(F.col("new_status").isNotNull(), F.col("new_status"))
                     .otherwise(F.col("account_status")).alias("account_status"),
                    "created_at")


def order_status_updates(orders: DataFrame, feed: DataFrame) -> DataFrame:
    """Normalized status changes with the old status; unknown values become 'pending'."""
    ch = feed.select("seq", "order_id", _member_or(F.col("status"), ORDER_STATUSES, "pending").alias("new_status"))
    return ch.join(orders.select(F.col("id").alias("order_id"), F.col("status").alias("old_status")), "order_id")


def apply_order_status(orders: DataFrame, feed: DataFrame) -> DataFrame:
    """M8. Bulk order status change. Stock is not given back on cancel (Q8)."""
    last = last_per_key(order_status_updates(orders, feed).drop("old_status"), ["order_id"])
    j = orders.join(last.select(F.col("order_id").alias("id"), "new_status"), "id", "left")
    return j.select("id", "user_id", "delivery_address_id",
                    F.coalesce("new_status", "status").alias("status"), "created_at")


# ----------------------------------------------------------------- products (M1)
def apply_product_changes(t: Tables, feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M1. Seller product add / update / delete requests, served one after the other (``seq``).

    Each request sees the state that the ones before left: a product can be changed from the add that made it up to its
    owner's first delete, after which nothing matches it. An add carries the id that it is assigned, so an id that is or
    was in use is a mistake in the feed and rejected. Deletes that match nothing are ignored, as in the reference.

    In columns: per product, the first valid add, then the owner's first delete after it, then the owner's last valid
    update between the two; no request list of a product is ever held in one place.
    """
    f = feed.select("seq", "op", "product_id",
                    php_trim(F.col("name")).alias("name"), php_trim(F.col("description")).alias("description"),
                    php_trim(F.col("image_url")).alias("image_url"), "price", php_int(F.col("stock")).alias("stock"),
                    php_int(F.col("category_id")).alias("category_id"), F.col("seller_id").alias("actor"))
    cats = t.categories.select(F.col("id").alias("category_id"), F.lit(True).alias("cat_ok"))
    fields_bad = ((F.coalesce(F.col("name"), F.lit("")) == "") | (F.coalesce(F.col("description"), F.lit("")) == "")
                  | (F.coalesce(F.col("image_url"), F.lit("")) == "") | ~(F.coalesce(F.col("price") > 0, F.lit(False)))
                  | (F.col("stock") < 0) | ~fits_int(F.col("stock")) | (F.col("category_id") <= 0))
    f = f.join(cats, "category_id", "left").withColumn(
        "form_reason", F.when(fields_bad, F.lit(MSG_FIELDS)).when(F.col("cat_ok").isNull(), F.lit(MSG_NO_CATEGORY)))
    valid = F.col("form_reason").isNull()
    cur = t.products.select(F.col("id").alias("product_id"), F.col("seller_id").alias("base_owner"), F.lit(True).alias("in_base"))
    adds = f.filter((F.col("op") == "add") & valid).groupBy("product_id").agg(F.min(F.struct("seq", "actor")).alias("add"))
    life = adds.join(cur, "product_id", "full_outer").select(
        "product_id", F.coalesce("in_base", F.lit(False)).alias("in_base"),
        F.when(F.col("in_base"), F.col("base_owner")).otherwise(F.col("add.actor")).alias("owner"),
        F.when(~F.coalesce("in_base", F.lit(False)), F.col("add.seq")).alias("add_seq"))
    seen = f.join(life, "product_id", "left")
    alive = F.col("in_base") | (F.col("seq") > F.col("add_seq"))
    mine = F.coalesce(alive & (F.col("owner") == F.col("actor")), F.lit(False))
    ends = seen.filter((F.col("op") == "delete") & mine).groupBy("product_id").agg(F.min("seq").alias("end_seq"))
    seen = seen.join(ends, "product_id", "left")
    matches = mine & (F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq")))
    added = F.coalesce(F.col("seq") == F.col("add_seq"), F.lit(False))
    reason = (F.when(F.col("op") == "delete", F.lit(None))
               .when((F.col("op") == "update") & ~matches, F.lit(MSG_NOT_FOUND))
               .when(~valid, F.col("form_reason"))
               .when((F.col("op") == "add") & ~added, F.lit(MSG_ID_TAKEN)))
    seen = seen.withColumn("reason", reason)
    rejects = seen.filter(F.col("reason").isNotNull()).select("seq", "op", "product_id", "reason")
    wins = seen.filter(F.col("reason").isNull() & (F.col("op") != "delete"))
    fields = ["name", "description", "image_url", "price", "stock", "category_id"]
    last = last_per_key(wins.select("seq", "product_id", *[F.col(c).alias(f"n_{c}") for c in fields]), ["product_id"]).drop("seq")
    dead = ends.select("product_id")
    base = t.products.withColumnRenamed("id", "product_id").join(dead, "product_id", "left_anti")
    kept = base.join(last.withColumn("hit", F.lit(True)), "product_id", "left").select(
        F.col("product_id").alias("id"),
        *[F.when(F.col("hit"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in fields], "seller_id", "created_at")
    new = life.filter(~F.col("in_base") & F.col("add_seq").isNotNull()).join(dead, "product_id", "left_anti").join(last, "product_id").select(
        F.col("product_id").alias("id"), *[F.col(f"n_{c}").alias(c) for c in fields], F.col("owner").alias("seller_id"),
        ts_literal(DEFAULT_AS_OF).alias("created_at"))
    return conform(kept, "products").unionByName(conform(new, "products")), rejects


# ----------------------------------------------------------------- table sizes
def table_row_counts(t: Tables) -> DataFrame:
    """Rows per table, the stored rating summary included if there is one (used to report a cascade's effect)."""
    tables = [*t.items(), *[(n, t.extras[n]) for n in ("rating_summary",) if t.extras.get(n) is not None]]
    parts = [df.agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left")
             for name, df in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ----------------------------------------------------------------- addresses
def upsert_addresses(t: Tables, feed: DataFrame, as_of: dt.datetime = DEFAULT_AS_OF) -> tuple[DataFrame, DataFrame]:
    """M10. Checkout address form: overwrite the user's saved address or insert one; set default.

    Rows with a blank field or an invalid phone are rejected before any change.
    The saved address is the one checkout shows: default first, lowest id.
    """
    from souk.operators.listings import default_address

    f = feed.select("seq", "user_id", php_trim(F.col("phone")).alias("phone"),
                    php_trim(F.col("city")).alias("city"), php_trim(F.col("address")).alias("address"))
    reason = (F.when((F.col("phone") == "") | (F.col("city") == "") | (F.col("address") == ""), F.lit(MSG_ADDRESS))
               .when(~phone_valid(F.col("phone")), F.lit(MSG_PHONE)))
    f = f.withColumn("reason", reason)
    rejects = f.filter(F.col("reason").isNotNull()).select("seq", "user_id", "reason")
    good = last_per_key(f.filter(F.col("reason").isNull()).drop("reason"), ["user_id"]) \
        .withColumn("phone", collapse_ws(F.col("phone")))
    saved = default_address(t).select("user_id", F.col("id").alias("saved_id"))
    g = good.join(saved, "user_id", "left")
    updates = g.filter(F.col("saved_id").isNotNull()).select(
        F.col("saved_id").alias("id"), "phone", "city", "address")
    start = t.user_addresses.select(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()
    inserts = number_rows(g.filter(F.col("saved_id").isNull()), "seq", "id", start=start).select(
        "id", "user_id", "phone", "city", "address", F.lit(True).alias("is_default"),
        ts_literal(as_of).alias("created_at"))
    base = t.user_addresses.join(updates.select("id", *[F.col(c).alias(f"n_{c}") for c in ("phone", "city",
                                                                                           "address")],
                                                F.lit(True).alias("hit")), "id", "left")
    updated = base.select("id", "user_id",
                          *[F.when(F.col("hit"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
                            for c in ("phone", "city", "address")],
                          F.when(F.col("hit"), F.lit(True)).otherwise(F.col("is_default")).alias("is_default"),
                          "created_at")
    return conform(updated, "user_addresses").unionByName(conform(inserts, "user_addresses")), rejects


# ----------------------------------------------------------------- cart (M3)
#: Actions of one (user, product) pair that one task replays; a pair with more is cut into ranges of ``seq``.
PAIR_ROWS = 20_000
_PAIR = ["user_id", "product_id"]
_CODES = ("remove", "add", "set")


def _cart_changes(op: np.ndarray, quantity: np.ndarray, stock: np.ndarray, known: np.ndarray) -> Pieces:
    """Each action as a function of the line's quantity: a shift where an add fits, a constant for a set that finds a line."""
    n, low = len(op), -LIMIT
    fits = known & (quantity <= stock)
    add, put = (op == 1) & known, (op == 2) & fits
    # pieces of a row: from -LIMIT; for an add from the first quantity that no longer fits; for a set at 0 and from 1
    top = np.where(add, np.maximum(stock - quantity + 1, low + 1), 0)
    node = np.concatenate((np.arange(n), np.flatnonzero(add), np.flatnonzero(put), np.flatnonzero(put)))
    lo = np.concatenate((np.full(n, low), top[add], np.zeros(put.sum(), np.int64), np.ones(put.sum(), np.int64)))
    slope = np.concatenate(((op != 0) & ~put, np.ones(add.sum(), bool), np.ones(put.sum(), bool), np.zeros(put.sum(), bool)))
    value = np.concatenate((np.where(add | put, quantity, 0), np.zeros(add.sum(), np.int64), np.zeros(put.sum(), np.int64), quantity[put]))
    order = np.lexsort((lo, node))
    return Pieces(node[order], lo[order], slope[order].astype(np.int64), value[order])


def _actions(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(op code, quantity from 1 up, stock, whether the product is known) of a batch's columns, clamped to the scan's range."""
    op = pc.index_in(batch["op"], value_set=pa.array(_CODES))
    op = np.asarray(pc.fill_null(op, _CODES.index("set")))  # whatever is no add or remove sets a quantity
    quantity = np.clip(np.asarray(pc.fill_null(batch["quantity"], 0)), 1, LIMIT // 2 - 1)
    return op, quantity, np.asarray(pc.fill_null(batch["stock"], 0)).astype(np.int64), np.asarray(batch["stock"].is_valid())


def _runs(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, tuple, tuple]:
    """(number of each row's run of equal keys, the first run's key, the last run's key)."""
    columns = [np.asarray(batch[k]) for k in keys]
    change = np.zeros(batch.num_rows, bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change), tuple(c[0] for c in columns), tuple(c[-1] for c in columns)


def _range_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One composed function of each (pair, range); a function is carried on over batches, rows never are."""
    def out(key: tuple, f: Pieces) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([int(k)]) for k in key[:2]), pa.array([int(key[2])], pa.int32()),
                                           *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (f.lo, f.slope, f.value))],
                                          ["user_id", "product_id", "range", "lo", "slope", "value"])

    key, held = None, None
    for b in batches:
        if b.num_rows == 0:
            continue
        run, first, last = _runs(b, [*_PAIR, "range"])
        made, _ = compose_runs(_cart_changes(*_actions(b)), run)
        n = int(run[-1]) + 1
        keys = [np.asarray(b[k])[np.searchsorted(run, np.arange(n))] for k in (*_PAIR, "range")]
        for i in range(n):  # ranges, not rows
            own = made.take(np.arange(n) == i)
            now = tuple(k[i] for k in keys)
            if now == key:
                held = held.then(own)
                continue
            if key is not None:
                yield out(key, held)
            key, held = now, own
    if key is not None:
        yield out(key, held)


def _range_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The quantity before each range of a pair: its ranges' functions applied one after the other."""
    pair, state = None, 0
    for b in batches:
        users, products, ranges, first = (b[c].to_pylist() for c in ("user_id", "product_id", "range", "first"))
        starts = []
        for i, now in enumerate(zip(users, products)):
            if now != pair:
                pair, state = now, first[i]
            starts.append(state)
            lo, slope, value = (np.asarray(b[c][i].values) for c in ("lo", "slope", "value"))
            state = int(Pieces(np.zeros(len(lo), np.int64), lo, slope, value).at(np.zeros(1, np.int64), np.array([state]))[0])
        yield pa.RecordBatch.from_arrays([b["user_id"], b["product_id"], b["range"], pa.array(starts, pa.int64())],
                                         [*_PAIR, "range", "start"])


_REPLAYED = ("seq long, user_id long, product_id long, op string, init_id long, qty_before long, qty_after long, stock int, quantity long")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The quantity before and after every action, from the quantity before its range."""
    key, state = None, 0
    for b in batches:
        if b.num_rows == 0:
            continue
        run, first, last = _runs(b, [*_PAIR, "range"])
        start = np.asarray(b["start"])[np.searchsorted(run, np.arange(int(run[-1]) + 1))].copy()
        if first == key:
            start[0] = state
        changes = _cart_changes(*_actions(b))
        before = states_before(compose_runs(changes, run)[1], start)
        after = changes.at(np.arange(len(before)), before)
        key, state = last, after[-1]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in ("seq", "user_id", "product_id", "op", "init_id")), pa.array(before),
                                          pa.array(after), b["stock"], b["quantity"]],
                                         ["seq", "user_id", "product_id", "op", "init_id", "qty_before", "qty_after", "stock", "quantity"])


def cart_events(t: Tables, feed: DataFrame, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """M3 core: every feed row with its decision and the pair's quantity after it.

    An action is a function of the line's quantity (``plans/scans.py``). Pairs are replayed in order of ``seq``, batch by
    batch in vectorised scans. A pair with more than ``pair_rows`` actions is cut into ranges of ``seq``: its
    ranges are composed side by side into one function each, the functions applied in turn give the quantity
    before each range, and the ranges are replayed side by side.
    """
    prods = t.products.select(F.col("id").alias("product_id"), "stock")
    init = t.cart.select("user_id", "product_id", F.col("quantity").alias("init_qty"), F.col("id").alias("init_id"))
    ev = feed.select("seq", *_PAIR, "op", php_int(F.col("quantity")).alias("quantity"))
    hot = ev.groupBy(*_PAIR).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > pair_rows).select(*_PAIR, F.lit(True).alias("hot"))
    hot = written(hot, "cart-hot-pairs")
    first = F.coalesce(F.col("init_qty"), F.lit(0)).cast("long")
    joined = ev.join(prods, "product_id", "left").join(init, _PAIR, "left")
    cut = None if hot.isEmpty() else order_bucket(ev, "seq")
    if cut is None:
        rows = joined.withColumns({"range": F.lit(0), "start": first})
    else:
        ranged = joined.join(hot, _PAIR, "left").withColumn("range", F.when(F.col("hot"), cut).otherwise(F.lit(0)))
        long_runs = ranged.filter("hot").select("seq", *_PAIR, "range", "op", "quantity", "stock")
        functions = long_runs.repartition(*_PAIR, "range").sortWithinPartitions(*_PAIR, "range", "seq").mapInArrow(
            _range_functions, "user_id long, product_id long, range int, lo array<long>, slope array<long>, value array<long>")
        functions = functions.join(init, _PAIR, "left").select(*_PAIR, "range", "lo", "slope", "value", first.alias("first"))
        starts = functions.repartition(*_PAIR).sortWithinPartitions(*_PAIR, "range").mapInArrow(
            _range_starts, "user_id long, product_id long, range int, start long")
        rows = ranged.join(written(starts, "cart-range-starts"), [*_PAIR, "range"], "left") \
            .withColumn("start", F.coalesce("start", first))
    rows = rows.select("seq", *_PAIR, "range", "op", "quantity", "stock", "init_id", "start")
    done = rows.repartition(*_PAIR, "range").sortWithinPartitions(*_PAIR, "range", "seq").mapInArrow(_replay, _REPLAYED)
    wanted = F.greatest(F.lit(1).cast("long"), "quantity")
    reason = (F.when(F.col("op") == "remove", F.lit(None))
               .when((F.col("op") == "add") & F.col("stock").isNull(), F.lit(MSG_NOT_FOUND))
               .when((F.col("op") == "add") & (wanted > F.col("stock") - F.col("qty_before")), F.lit(MSG_STOCK))
               .when((F.col("op") != "add") & (F.col("qty_before") == 0), F.lit(MSG_NO_CART_ITEM))
               .when((F.col("op") != "add") & (F.col("stock").isNull() | (wanted > F.col("stock"))), F.lit(MSG_STOCK)))
    done = done.withColumn("reason", reason)
    made = (F.col("op") == "add") & F.col("reason").isNull() & (F.col("qty_before") == 0)
    return done.select("seq", *_PAIR, "op", F.col("reason").isNull().alias("accepted"), "reason",
                       F.col("qty_after").cast("int").alias("qty_after"), F.when(made, F.col("seq")).alias("made_seq"), "init_id")


def apply_cart_changes(t: Tables, feed: DataFrame, pair_rows: int = PAIR_ROWS) -> tuple[DataFrame, DataFrame]:
    """M3. Add / set / remove cart actions; returns (cart, rejects)."""
    ev = cart_events(t, feed, pair_rows)
    # a line that was there from the start was never made anew: a remove leaves nothing, and only an add makes a line
    final = ev.groupBy(*_PAIR).agg(F.max(F.struct("seq", "qty_after", "init_id")).alias("last"), F.max("made_seq").alias("created_seq")) \
        .select(*_PAIR, "last.qty_after", "last.init_id", "created_seq")
    untouched = t.cart.join(final.select(*_PAIR), _PAIR, "left_anti")
    live = final.filter(F.col("qty_after") > 0)
    kept = live.filter(F.col("created_seq").isNull()).select(
        F.col("init_id").alias("id"), "user_id", "product_id", F.col("qty_after").alias("quantity"))
    start = t.cart.select(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()
    fresh = number_rows(live.filter(F.col("created_seq").isNotNull()), "created_seq", "id", start=start).select(
        "id", "user_id", "product_id", F.col("qty_after").alias("quantity"))
    state = untouched.unionByName(conform(kept, "cart")).unionByName(conform(fresh, "cart"))
    rejects = ev.filter(~F.col("accepted")).select("seq", "user_id", "product_id", "op", "reason")
    return state, rejects
