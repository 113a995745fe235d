"""M5: bulk checkout of many carts against shared stock.

Sequential meaning (the reference's row locks): requests are served in ``seq`` order; a cart is accepted, whole, when every
line's quantity fits the stock left by the carts accepted before it; otherwise it is rejected whole. Accepting
creates an order, its lines (price snapshot), a payment and an invoice, deducts stock and clears the cart. So a user's later
request finds an empty cart after an accepted one; after a rejected one it finds the same cart and no more stock than
before, and is rejected again. Only the first request of each user has to be decided.

Parallel evaluation. Each round, per product and in request order, two running sums over earlier carts' lines:

  sure     = units of earlier carts already accepted
  possible = units of earlier carts accepted or still undecided

An undecided cart with a line where ``sure + qty > stock`` is rejected (what was accepted before it can only be more);
one where every line has ``possible + qty <= stock`` is accepted (what is accepted before it can only be less).
Chains of carts whose fate hangs on the one before are not left to more rounds: from the second round on, the earliest
undecided carts (a block of bounded size) are folded exactly, in request order. Carts that share no contended product
cannot affect each other, so a block of more than ``FOLD_CARTS`` is cut into connected components that are folded in
parallel. Any block is a prefix in request order, so its size changes speed and never the result. Rejected carts and
folded products leave the working set; each round's state is written to the shared folder and the old one deleted.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.money import invoice_number, money, sum_of_lines, with_totals
from souk.functions.text import ts_literal
from souk.functions.text import digits_only, luhn_valid, phone_valid, php_trim
from souk.plans.numbering import number_rows, order_bucket, running_sums
from souk.session import discard, written
from souk.sources.tables import Tables, conform

# The procedure's error messages.
MSG_EMPTY = "Cart is empty"
MSG_STOCK = "Insufficient stock"
MSG_CARD = "Please enter a valid card number or choose cash."
DEFAULT_AS_OF = dt.datetime(2000, 1, 1)

#: Undecided carts that one task folds, and that a round folds in all (as components of a prefix).
FOLD_CARTS, ROUND_CARTS = 20_000, 640_000


@dataclass
class CheckoutResult:
    decisions: DataFrame   # one row per request
    orders: DataFrame      # new order rows with totals, payment and invoice
    order_items: DataFrame
    stock: DataFrame       # product id and stock after deduction
    tables: Tables         # full new state
    rounds: int


def _merged(side: DataFrame) -> DataFrame:
    """The side of a join by sort and merge: a broadcast would bring it to the driver, and checkout makes dozens of joins of sides
    that grow with the carts."""
    return side.hint("merge")


def _sums(lines: DataFrame, base: DataFrame) -> DataFrame:
    """Undecided carts' lines with the units left before them: ``room`` surely at most, ``safe`` at least.

    ``lines`` carries each line's cart status (A or U); ``base`` holds, per product, the units of accepted carts
    already folded away (all of them earlier than every undecided cart of that product).
    """
    sums = running_sums(
        lines, ["product_id"], ["seq"],
        {"sure": F.when(F.col("status") == "A", F.col("quantity")).otherwise(F.lit(0)),
         "possible": F.col("quantity")},
        inclusive=False, bucket=F.col("bucket"))
    left = F.col("stock") - F.coalesce("base", F.lit(0))
    return sums.filter(F.col("status") == "U").join(_merged(base), "product_id", "left").select(
        "seq", "product_id", "quantity", (left - F.col("sure")).alias("room"), (left - F.col("possible")).alias("safe"))


def _flags(sums: DataFrame) -> DataFrame:
    """New status per undecided cart from the two running sums."""
    flags = sums.groupBy("seq").agg(
        F.max((F.col("quantity") > F.col("room")).cast("int")).alias("fail"),
        F.min((F.col("quantity") <= F.col("safe")).cast("int")).alias("ok"))
    return flags.select("seq", F.when(F.col("fail") == 1, "R").when(F.col("ok") == 1, "A").otherwise("U").alias("new_status"))


def _components(lines: DataFrame) -> DataFrame:
    """(seq, part): carts joined by shared products get one label, by passing least labels along and on."""
    label = written(lines.select("product_id", F.col("product_id").alias("label")).distinct(), "checkout-label")
    total = None
    while True:
        carts = lines.join(_merged(label), "product_id").groupBy("seq").agg(F.min("label").alias("label"))
        near = lines.join(_merged(carts), "seq").groupBy("product_id").agg(F.min("label").alias("label"))
        hop = near.select(F.col("product_id").alias("label"), F.col("label").alias("further"))
        new = written(near.join(_merged(hop), "label").select("product_id", F.col("further").alias("label")), "checkout-label")
        discard(label)
        label, before = new, total
        total = label.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return lines.join(_merged(label), "product_id").groupBy("seq").agg(F.min("label").alias("part"))


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Serve one component's carts in request order; ``room`` is each line's stock before any cart of the block."""
    used: dict[int, int] = {}
    seqs, status = [], []
    pdf = pdf.sort_values("seq", kind="stable")
    rows = list(zip(pdf["seq"].tolist(), pdf["product_id"].tolist(), pdf["quantity"].tolist(), pdf["room"].tolist()))
    at = 0
    while at < len(rows):
        to = at
        while to < len(rows) and rows[to][0] == rows[at][0]:
            to += 1
        fits = all(used.get(p, 0) + q <= room for _, p, q, room in rows[at:to])
        if fits:
            for _, p, q, _ in rows[at:to]:
                used[p] = used.get(p, 0) + q
        seqs.append(rows[at][0])
        status.append("A" if fits else "R")
        at = to
    return pd.DataFrame({"seq": seqs, "folded": status})


def _fold_block(sums: DataFrame, undecided: int, fold_carts: int, round_carts: int) -> DataFrame:
    """(seq, folded): exact decisions of the earliest undecided carts."""
    if undecided > round_carts:
        cut = sums.select(F.col("seq").cast("double").alias("k")).approxQuantile("k", [round_carts / undecided], 0.0001)[0]
        least = sums.agg(F.min("seq")).first()[0]
        sums = sums.filter(F.col("seq") <= F.lit(max(int(cut), least)))
    if undecided <= fold_carts:
        parts = sums.withColumn("part", F.lit(0).cast("long"))
    else:
        parts = sums.join(_merged(_components(sums.select("seq", "product_id"))), "seq")
        # a component larger than one task's block gives its first carts only
        first = parts.groupBy("part", "seq").count().drop("count")
        grid = -(-round_carts // fold_carts)
        cuts = F.percentile_approx("seq", [k / grid for k in range(1, grid + 1)], 10_000)
        size = first.groupBy("part").agg(F.count(F.lit(1)).alias("n"), cuts.alias("cuts"), F.min("seq").alias("least"))
        nth = F.least(F.lit(grid), F.greatest(F.lit(1), F.floor(F.lit(grid * fold_carts) / F.col("n")))).cast("int")
        size = size.select("part", "n", "least", F.element_at("cuts", nth).alias("cut"))
        parts = parts.join(_merged(size), "part").filter((F.col("n") <= fold_carts) | (F.col("seq") <= F.greatest("cut", "least")))
    return parts.groupBy("part").applyInPandas(lambda pdf: _fold(pdf), "seq long, folded string")


def decide(lines: DataFrame, fold_carts: int = FOLD_CARTS, round_carts: int = ROUND_CARTS) -> tuple[DataFrame, int]:
    """Iterate rounds to the fixpoint. ``lines``: seq, product_id, quantity, stock.

    Each round first shrinks the working set: per product, accepted lines earlier than the product's first undecided cart
    are folded into a per-product base, products without undecided carts leave, and rejected carts' lines leave.
    Returns (seq, status) for every cart with lines, and the round count.
    """
    bucket = order_bucket(lines, "seq")
    work = written(lines.withColumn("bucket", bucket if bucket is not None else F.lit(0)), "checkout-work")
    status = written(work.select("seq").distinct().withColumn("status", F.lit("U")), "checkout-status")
    base = work.select("product_id", F.lit(0).cast("bigint").alias("base")).limit(0)
    rounds, left, owned = 0, status.count(), []
    while left:
        rounds += 1
        cur = work.join(_merged(status.filter(F.col("status") != "R")), "seq")
        front = cur.filter(F.col("status") == "U").groupBy("product_id").agg(F.min("seq").alias("front"))
        cur = cur.join(_merged(front), "product_id")
        folded = cur.filter(F.col("seq") < F.col("front")).groupBy("product_id").agg(F.sum("quantity").cast("bigint").alias("base"))
        new_base = written(base.unionByName(folded).groupBy("product_id").agg(F.sum("base").alias("base")), "checkout-base")
        new_work = written(cur.filter(F.col("seq") >= F.col("front")).drop("front", "status"), "checkout-work")
        sums = written(_sums(new_work.join(_merged(status), "seq"), new_base), "checkout-sums")
        new = _flags(sums)
        if rounds > 1:
            new = new.join(_merged(_fold_block(sums, left, fold_carts, round_carts)), "seq", "left") \
                .select("seq", F.coalesce("folded", "new_status").alias("new_status"))
        new_status = written(status.join(_merged(new), "seq", "left").select("seq", F.coalesce("new_status", "status").alias("status")),
                             "checkout-status")
        discard(work, status, sums, *owned)
        work, status, base, owned = new_work, new_status, new_base, [new_base]
        before, left = left, status.filter(F.col("status") == "U").count()
        if rounds > 1 and left >= before:
            # Impossible by construction: the earliest undecided cart always resolves.
            raise RuntimeError(f"checkout made no progress in round {rounds} ({left} carts undecided)")
    discard(work, *owned)
    return status, rounds


def checkout(t: Tables, requests: DataFrame, as_of: dt.datetime = DEFAULT_AS_OF) -> CheckoutResult:
    """Serve ``requests`` (seq, user_id, address_id, payment_method, card_last4) in seq order."""
    prods = t.products.select(F.col("id").alias("product_id"), "price", "stock")
    req = written(requests.select("seq", "user_id", "address_id", "payment_method", "card_last4"), "checkout-requests")
    first = req.groupBy("user_id").agg(F.min("seq").alias("seq"))
    lines = written(first.join(_merged(t.cart), "user_id").join(_merged(prods), "product_id"), "checkout-lines")
    quotes = lines.groupBy("seq").agg(
        sum_of_lines(F.col("quantity"), F.col("price")).alias("subtotal"),
        F.count(F.lit(1)).alias("n_lines"))
    nonempty = quotes.filter(F.col("subtotal") > 0).select("seq")
    work_lines = lines.join(_merged(nonempty), "seq", "left_semi").select("seq", "product_id", "quantity", "stock")
    status, rounds = decide(work_lines)

    outcome = first.withColumnRenamed("seq", "first_seq").join(
        _merged(quotes.withColumnRenamed("seq", "first_seq")), "first_seq", "left").join(
        _merged(status.withColumnRenamed("seq", "first_seq")), "first_seq", "left")
    later = F.col("seq") > F.col("first_seq")
    emptied = later & F.coalesce(F.col("status") == "A", F.lit(False))  # an earlier request took the cart
    decisions = (req.join(_merged(outcome), "user_id", "left")
                 .withColumn("subtotal", F.when(emptied, F.lit(0).cast("decimal(38,2)")).otherwise(F.col("subtotal")))
                 .withColumn("reason", F.when(F.coalesce(F.col("subtotal"), F.lit(0)) <= 0, F.lit(MSG_EMPTY))
                                        .when(F.col("status") == "R", F.lit(MSG_STOCK)))
                 .withColumn("decision", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")))
    accepted = decisions.filter(F.col("decision") == "accepted")
    next_id = lambda df: df.select(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
    start = next_id(t.orders)
    numbered = written(number_rows(accepted.drop("first_seq", "status"), "seq", "order_id", start=start),
                       "checkout-orders")
    totals = with_totals(numbered.select("seq", "order_id", "subtotal"))
    decisions = (decisions.join(_merged(totals.select("seq", "order_id", "tax_amount", "total_amount")), "seq", "left")
                 .select("seq", "user_id", "decision", "reason",
                         money(F.coalesce("subtotal", F.lit(0))).alias("subtotal"),
                         "tax_amount", "total_amount", "order_id"))

    # Every new row is numbered after its own table's largest id: orders in request order, lines by order and product.
    created = ts_literal(as_of)
    nth = F.col("order_id") - F.lit(start)
    new_orders = numbered.select(F.col("order_id").alias("id"), "user_id", F.col("address_id").alias(
        "delivery_address_id"), F.lit("pending").alias("status"), created.alias("created_at"))
    acc_lines = lines.join(_merged(numbered.select("seq", "order_id")), "seq")
    ahead = running_sums(numbered.select("order_id", "n_lines"), [], ["order_id"], {"ahead": F.col("n_lines")})
    in_order = F.row_number().over(Window.partitionBy("order_id").orderBy("product_id"))
    new_items = acc_lines.join(_merged(ahead.select("order_id", "ahead")), "order_id").select(
        (F.lit(next_id(t.order_items)) + F.col("ahead") + in_order - 1).cast("bigint").alias("id"), "order_id", "product_id", "quantity", "price")
    new_payments = numbered.select(
        (F.lit(next_id(t.payments)) + nth).alias("id"), "order_id", "payment_method",
        F.when(F.col("payment_method") == "card", F.col("card_last4")).alias("card_last4"),
        F.when(F.col("payment_method") == "card", "paid").otherwise("pending").alias("payment_status"),
        created.alias("created_at"))
    new_invoices = numbered.select((F.lit(next_id(t.invoices)) + nth).alias("id"), "order_id",
                                   invoice_number(F.col("order_id")).alias("invoice_number"),
                                   created.alias("issued_at"))
    used = acc_lines.groupBy("product_id").agg(F.sum("quantity").alias("used"))
    products = (t.products.join(_merged(used.withColumnRenamed("product_id", "id")), "id", "left")
                .withColumn("stock", (F.col("stock") - F.coalesce("used", F.lit(0))).cast("int")).drop("used"))
    done_users = numbered.select("user_id")
    cart = t.cart.join(_merged(done_users), "user_id", "left_anti")
    new_t = t.with_(orders=t.orders.unionByName(conform(new_orders, "orders")),
                    order_items=t.order_items.unionByName(conform(new_items, "order_items")),
                    payments=t.payments.unionByName(conform(new_payments, "payments")),
                    invoices=t.invoices.unionByName(conform(new_invoices, "invoices")),
                    products=conform(products, "products"), cart=cart)
    orders_out = (new_orders.join(_merged(totals.select(F.col("order_id").alias("id"), "subtotal", "tax_amount",
                                                        "total_amount")), "id")
                  .join(_merged(new_payments.drop("id").select(F.col("order_id").alias("id"), "payment_method", "card_last4",
                                                               "payment_status")), "id")
                  .join(_merged(new_invoices.drop("id").select(F.col("order_id").alias("id"), "invoice_number")), "id"))
    return CheckoutResult(decisions=decisions, orders=orders_out, order_items=new_items,
                          stock=products.select("id", "stock"), tables=new_t, rounds=rounds)


def serve_forms(t: Tables, forms: DataFrame, as_of: dt.datetime = DEFAULT_AS_OF) -> tuple[CheckoutResult, DataFrame]:
    """The checkout page: forms (seq, user_id, phone, city, address, payment_method, card_number) in ``seq`` order.

    A payment method other than card is cash; address, phone and card are checked before anything changes; the address of an
    accepted order is saved (a later accepted order cannot exist, its cart is empty). Returns the checkout and the
    rejected forms (seq, user_id, reason).
    """
    from souk.operators.changes import MSG_ADDRESS, MSG_PHONE, upsert_addresses
    from souk.operators.listings import default_address

    f = forms.select("seq", "user_id", *[php_trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("phone", "city", "address")],
                     F.when(F.col("payment_method") == "card", "card").otherwise("cash").alias("payment_method"),
                     digits_only(F.coalesce("card_number", F.lit(""))).alias("digits"))
    reason = (F.when((F.col("phone") == "") | (F.col("city") == "") | (F.col("address") == ""), F.lit(MSG_ADDRESS))
               .when(~phone_valid(F.col("phone")), F.lit(MSG_PHONE))
               .when((F.col("payment_method") == "card") & ~luhn_valid(F.col("digits")), F.lit(MSG_CARD)))
    f = written(f.withColumn("reason", reason), "checkout-forms")
    rejects = f.filter(F.col("reason").isNotNull()).select("seq", "user_id", "reason")
    requests = f.filter(F.col("reason").isNull()).select(
        "seq", "user_id", F.lit(None).cast("bigint").alias("address_id"), "payment_method",
        F.when(F.col("payment_method") == "card", F.right("digits", F.lit(4))).alias("card_last4"))
    done = checkout(t, requests, as_of)
    accepted = done.decisions.filter(F.col("decision") == "accepted").select("seq")
    addresses, _ = upsert_addresses(t, f.join(accepted, "seq", "left_semi").select("seq", "user_id", "phone", "city", "address"), as_of)
    saved = default_address(t.with_(user_addresses=addresses)).select("user_id", F.col("id").alias("saved_id"))

    def placed(orders: DataFrame, own: DataFrame) -> DataFrame:
        """Give the new orders their saved address."""
        new = own.select("id").withColumn("is_new", F.lit(True))
        j = orders.join(new, "id", "left").join(saved, "user_id", "left")
        return j.withColumn("delivery_address_id", F.when(F.col("is_new"), F.col("saved_id")).otherwise(F.col("delivery_address_id"))) \
            .select(*orders.columns)

    tables = done.tables.with_(user_addresses=addresses, orders=placed(done.tables.orders, done.orders))
    return CheckoutResult(decisions=done.decisions, orders=placed(done.orders, done.orders), order_items=done.order_items,
                          stock=done.stock, tables=tables, rounds=done.rounds), rejects
