"""Properties: invariants and brute-force comparisons on random inputs."""

import random
from decimal import Decimal as D

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from souk.functions.text import email_valid, php_int
from souk.operators import cascades, catalog, changes, checkout, quality, reports
from souk.plans import scans
from souk.plans.numbering import number_rows, order_bucket, running_sums
from souk.sources.seed import seed_tables


def test_daily_sales_sum_equals_summary(fx):
    t = fx.tables()
    total = reports.daily_sales(t).agg(F.sum("revenue")).collect()[0][0]
    assert total == reports.sales_summary(t).collect()[0]["revenue"]


def test_upsert_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    upd = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    once = changes.upsert(base, upd, ["k"])
    twice = changes.upsert(once, upd, ["k"])
    assert sorted(once.collect()) == sorted(twice.collect())
    assert dict((r["k"], r["v"]) for r in once.collect()) == {1: "a", 2: None, 3: "c"}  # NULL update kept


def test_running_sums_match_pandas_with_hot_key(spark):
    rng = random.Random(7)
    rows = [(i, 0 if rng.random() < 0.4 else rng.randint(1, 30), rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, k long, v long")
    got = running_sums(df, ["k"], ["seq"], {"run": F.col("v")}, inclusive=False, buckets=16)
    pdf = pd.DataFrame(rows, columns=["seq", "k", "v"]).sort_values("seq")
    pdf["run"] = pdf.groupby("k")["v"].cumsum() - pdf["v"]
    exp = dict(zip(pdf["seq"], pdf["run"]))
    assert {r["seq"]: r["run"] for r in got.collect()} == exp


def test_number_rows_dense(spark):
    df = spark.createDataFrame([(x * 7 % 1001,) for x in range(1001)], "seq long")
    got = sorted((r["seq"], r["n"]) for r in number_rows(df, "seq", "n", start=5).collect())
    assert [n for _, n in got] == list(range(5, 1006))


def test_number_rows_by_text_and_by_a_tuple_with_a_constant(spark):
    rows = [(0, f"name {i % 977:04d}", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "c int, name string, i long")
    got = number_rows(df, ["c", "name", "i"], "n").orderBy("n").collect()
    assert [(r["c"], r["name"], r["i"]) for r in got] == sorted(rows) and [r["n"] for r in got] == list(range(1, 4001))


def test_order_buckets_spread_constant_first_and_text_keys(spark):
    df = spark.createDataFrame([(0, f"name {i:05d}") for i in range(5000)], "c int, name string")
    for key in (["c", "name"], ["name"]):
        sizes = [r["count"] for r in df.groupBy(order_bucket(df, key, buckets=16).alias("b")).count().collect()]
        assert len(sizes) >= 12 and max(sizes) < 1500
    got = running_sums(df, ["c"], ["name"], {"run": F.lit(1)}, inclusive=True, buckets=16).orderBy("name").collect()
    assert [r["run"] for r in got] == list(range(1, 5001))
    assert order_bucket(df.limit(0), ["name"]) is None


def test_product_requests_equal_one_at_a_time(spark):
    """Random add / update / delete requests against a plain loop that serves them in order."""
    rng = random.Random(3)
    seed = seed_tables(spark)
    base = {r["id"]: {"owner": r["seller_id"], "name": r["name"], "stock": r["stock"]} for r in seed.products.collect()}
    rows = []
    for seq in range(400):
        bad = rng.random()
        rows.append((seq, rng.choice(["add", "update", "update", "delete"]), rng.randint(1, 40), "" if bad < 0.1 else f"  n{seq}\t", "d", "i",
                     D("0.00") if bad > 0.95 else D("2.50"), rng.choice(["7", " 12 pcs", "3.9", "x", "-1"]), "99" if 0.1 < bad < 0.2 else "2", rng.choice([3, 4])))
    feed = spark.createDataFrame(rows, "seq long, op string, product_id long, name string, description string, image_url string, "
                                       "price decimal(10,2), stock string, category_id string, seller_id long")
    state, ever, rejects = dict(base), set(base), {}
    for seq, op, pid, name, _, _, price, stock, category, actor in rows:
        stock = {"7": 7, " 12 pcs": 12, "3.9": 3, "x": 0, "-1": -1}[stock]
        bad = changes.MSG_FIELDS if not name.strip() or price <= 0 or stock < 0 else changes.MSG_NO_CATEGORY if category == "99" else None
        mine = pid in state and state[pid]["owner"] == actor
        if op == "delete":
            if mine:
                del state[pid]
        elif op == "update" and not mine:
            rejects[seq] = changes.MSG_NOT_FOUND
        elif bad:
            rejects[seq] = bad
        elif op == "update":
            state[pid] = {"owner": actor, "name": name.strip(), "stock": stock}
        elif pid in ever:
            rejects[seq] = changes.MSG_ID_TAKEN
        else:
            state[pid] = {"owner": actor, "name": name.strip(), "stock": stock}
            ever.add(pid)
    got, rej = changes.apply_product_changes(seed, feed)
    assert {r["id"]: {"owner": r["seller_id"], "name": r["name"], "stock": r["stock"]} for r in got.collect()} == state
    assert {r["seq"]: r["reason"] for r in rej.collect()} == rejects


def test_int_cast_of_form_text(spark):
    want = {"3a": 3, " 12 ": 12, "1.9": 1, "-4.2x": -4, "": 0, "abc": 0, "1e3": 1000, ".5": 0, "+7": 7, "99999999999": 99999999999, "--1": 0,
            "9007199254740993": 2**53 + 1, "99999999999999999999": 2**63 - 1, "-1e30": -(2**63), "1e400": 2**63 - 1}
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "t string").select("t", php_int(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == {**want, None: 0}


def test_scan_of_piecewise_changes_equals_one_after_the_other():
    rng = np.random.default_rng(7)
    for n, runs in ((1, 1), (2, 1), (7, 3), (500, 9), (3000, 1)):
        op, quantity = rng.integers(0, 3, n), rng.integers(1, 12, n)
        if n == 3000:
            op[:] = 1  # adds alone: every one a break point
        stock, known = rng.integers(0, 60 if n < 3000 else 4000, n), rng.random(n) < 0.95
        run = np.sort(rng.integers(0, runs, n))
        run = np.unique(run, return_inverse=True)[1]
        start = rng.integers(-2, 30, run[-1] + 1)
        f = changes._cart_changes(op, quantity, stock, known)
        whole, tree = scans.compose_runs(f, run)
        before = scans.states_before(tree, start)
        state = None
        for i in range(n):
            s = start[run[i]] if i == 0 or run[i] != run[i - 1] else state
            assert before[i] == s
            if op[i] == 0:
                state = 0
            elif op[i] == 1:
                state = s + quantity[i] if known[i] and s + quantity[i] <= stock[i] else s
            else:
                state = quantity[i] if s != 0 and known[i] and quantity[i] <= stock[i] else s
            assert f.at(np.array([i]), np.array([s]))[0] == state
            if i == n - 1 or run[i + 1] != run[i]:
                assert whole.at(np.array([run[i]]), np.array([start[run[i]]]))[0] == state


def test_hot_cart_pair_runs_in_many_tasks(spark, seed):
    """A pair with adds alone, without a remove to cut at: ranges side by side equal the plain loop."""
    rng, n = random.Random(3), 100_000
    stock = 60_000
    products = seed.products.withColumn("stock", F.when(F.col("id") == 1, F.lit(stock)).otherwise(F.col("stock")))
    quantity = [rng.randrange(1, 40) for _ in range(n)]
    feed = spark.createDataFrame(pd.DataFrame({"seq": range(n), "quantity": quantity})).selectExpr(
        "seq", "5L AS user_id", "1L AS product_id", "'add' AS op", "int(quantity) AS quantity")
    ev = changes.cart_events(seed.with_(products=products, cart=seed.cart.filter("user_id <> 5")), feed)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the test's rows would all fit one task
    try:
        got = ev.withColumn("task", F.spark_partition_id()).toPandas().sort_values("seq")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    s, after = 0, []
    for q in quantity:
        s = s + q if s + q <= stock else s
        after.append(s)
    assert got["qty_after"].tolist() == after and got["accepted"].tolist() == [a != b for a, b in zip(after, [0, *after])]
    assert got["task"].nunique() >= 4


def test_huge_cart_quantity_is_rejected(spark, seed):
    feed = spark.createDataFrame([(1, 5, 1, "add", "9999999999"), (2, 5, 1, "add", "99999999999999999999999")],
                                 "seq long, user_id long, product_id long, op string, quantity string")
    rejects = changes.apply_cart_changes(seed, feed)[1]
    assert sorted((r["seq"], r["reason"]) for r in rejects.collect()) == [(1, changes.MSG_STOCK), (2, changes.MSG_STOCK)]


def test_search_text_with_backslashes(spark, seed):
    names = ["a\\b", "ab", "100%", "100x", "a_c", "abc", "end\\", "50% off"]
    rows = [(i, n) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, name string")
    found = lambda s: {r["name"] for r in df.filter(F.col("name").ilike(catalog.like_text(f"%{s}%"))).collect()}
    assert found("a\\b") == {"ab", "abc"} and found("a\\\\b") == {"a\\b"}
    assert found("100\\%") == {"100%"} and found("100%") == {"100%", "100x"} and found("a\\_c") == {"a_c"}
    assert found("0\\") == {"50% off", "100%"} - {"50% off"}  # the closing wildcard becomes a plain sign
    assert catalog.catalog_search(seed, search="a\\b").count() == 0


def test_email_shape(spark):
    good = ["a@b.co", "first.last+tag@sub.example-site.org", "o'neil@x.io", "a" * 64 + "@example.com"]
    bad = ["a..b@x.com", ".a@x.com", "a.@x.com", "a" * 65 + "@x.com", "a@b", "a@-b.com", "a@b-.com", "a@@b.com", "a b@c.de", "", "a@" + "b" * 64 + ".com",
           "a@b.com\n" + "x" * 100, None]
    df = spark.createDataFrame([(e,) for e in good + bad], "e string").select("e", email_valid(F.col("e")).alias("ok"))
    assert {r["e"] for r in df.collect() if r["ok"]} == set(good)


def test_unique_check_passes_nulls_and_tells_pairs_apart(spark):
    seed = seed_tables(spark)
    invoices = spark.createDataFrame([(1, None, "A", None), (2, None, "B", None), (3, 7, "C", None), (4, 7, None, None), (5, 8, None, None)],
                                     "id long, order_id long, invoice_number string, issued_at timestamp_ntz")
    cart = spark.createDataFrame([(1, None, 5, 1), (2, 5, None, 1), (3, None, 5, 1), (4, 2, 3, 1), (5, 2, 3, 1)],
                                 "id long, user_id long, product_id long, quantity int")
    got = quality.check_unique(seed.with_(invoices=invoices, cart=cart)).collect()
    assert {(r["table_name"], r["key_columns"], r["key_value"], r["occurrences"]) for r in got} == {
        ("invoices", "order_id", "7", 2), ("cart", "user_id,product_id", "2|3", 2)}


def test_names_are_one_whatever_their_case_accents_and_trailing_blanks(spark, seed):
    feed = spark.createDataFrame([(1, "Café"), (2, "CAFE"), (3, "cafe  "), (4, "Straße"), (5, "STRASSE"), (6, "Tea")], "seq long, name string")
    got = changes.insert_ignore_categories(seed.categories, feed)
    new = got.join(seed.categories, "id", "left_anti").orderBy("id").collect()
    assert [r["name"] for r in new] == ["Café", "Straße", "Tea"]
    assert changes.insert_ignore_categories(got, feed).count() == got.count()
    rows = spark.createDataFrame([(1, "CAFÉ "), (2, "strasse"), (3, "Caf"), (4, "Cof_e")], "seq long, category_name string")
    loaded, rejected = catalog.load_catalog_feed(rows, got)
    assert sorted(r["seq"] for r in loaded.collect()) == [1, 2] and sorted(r["seq"] for r in rejected.collect()) == [3, 4]
    assert loaded.columns == ["seq", "category_name", "category_id"]
    twice = got.unionByName(spark.createDataFrame([(900, "cafe")], got.schema))
    found = quality.check_unique(seed.with_(categories=twice)).filter("table_name = 'categories'").collect()
    assert [(r["key_value"], r["occurrences"]) for r in found] == [("cafe", 2)]


def test_insert_ignore_keeps_the_first_spelling_in_order_of_arrival(spark):
    seed = seed_tables(spark)
    feed = spark.createDataFrame([(5, "zinc"), (1, "Zinc"), (3, " lamps "), (2, "Apple"), (4, ""), (6, "APPLE")], "seq long, name string")
    got = sorted((r["id"], r["name"]) for r in changes.insert_ignore_categories(seed.categories, feed).collect())
    assert got[5:] == [(6, "Zinc"), (7, "Apple")] and len(got) == 7


def _sequential_checkout(carts, stock):
    stock = dict(stock)
    accepted = []
    for user in sorted(carts):
        lines = carts[user]
        if not lines or all(q == 0 for _, q, _ in lines):
            continue
        if sum(q * p for _, q, p in lines) <= 0:
            continue
        if all(q <= stock[pid] for pid, q, _ in lines):
            for pid, q, _ in lines:
                stock[pid] -= q
            accepted.append(user)
    return accepted, stock


def test_checkout_equals_sequential_loop(spark):
    rng = random.Random(11)
    seed = seed_tables(spark)
    for trial in range(2):
        n_prod = 6
        stock = {p: rng.randint(0, 6) for p in range(1, n_prod + 1)}
        price = {p: D(f"{rng.randint(1, 50)}.{rng.randint(0, 99):02d}") for p in stock}
        carts, cart_rows, cid = {}, [], 1
        for user in range(100, 160):
            ps = rng.sample(sorted(stock), rng.randint(1, 3))
            carts[user] = [(p, rng.randint(1, 4), price[p]) for p in ps]
            for p, q, _ in carts[user]:
                cart_rows.append((cid, user, p, q))
                cid += 1
        prods = spark.createDataFrame(
            [(p, f"P{p}", "d", "i", price[p], stock[p], 1, 3, None) for p in stock], seed.products.schema)
        t = seed.with_(products=prods, cart=spark.createDataFrame(cart_rows, seed.cart.schema))
        req = spark.createDataFrame([(u, u, None, "cash", None) for u in carts],
                                    "seq long, user_id long, address_id long, payment_method string, card_last4 string")
        res = checkout.checkout(t, req)
        got = sorted(r["user_id"] for r in res.decisions.filter("decision = 'accepted'").collect())
        exp_acc, exp_stock = _sequential_checkout(carts, stock)
        assert got == sorted(exp_acc), f"trial {trial}"
        got_stock = {r["id"]: r["stock"] for r in res.stock.collect()}
        assert got_stock == exp_stock and min(got_stock.values()) >= 0
        assert res.rounds >= 1


def _cart_brute(init, stock, events):
    state = dict(init)
    rejects = []
    for seq, user, pid, op, q in sorted(events):
        key = (user, pid)
        s = state.get(key, 0)
        q = max(1, q)
        st = stock.get(pid)
        if op == "remove":
            state[key] = 0
        elif op == "add":
            if st is None or s + q > st:
                rejects.append(seq)
            else:
                state[key] = s + q
        else:
            if s == 0 or st is None or q > st:
                rejects.append(seq)
            else:
                state[key] = q
    return {k: v for k, v in state.items() if v > 0}, sorted(rejects)


def test_cart_changes_equal_brute_force(spark):
    rng = random.Random(5)
    seed = seed_tables(spark)
    stock = {r["id"]: r["stock"] for r in seed.products.collect()}
    events = [(i, rng.choice([5, 6]), rng.choice([1, 2, 6, 99]), rng.choice(["add", "add", "set", "remove"]),
               rng.randint(-1, 6)) for i in range(300)]
    feed = spark.createDataFrame(events, "seq long, user_id long, product_id long, op string, quantity int")
    plain = sorted(map(tuple, changes.cart_events(seed, feed).collect()))
    assert plain == sorted(map(tuple, changes.cart_events(seed, feed, pair_rows=20).collect()))  # long pairs cut into ranges
    state, rej = changes.apply_cart_changes(seed, feed)
    init = {(r["user_id"], r["product_id"]): r["quantity"] for r in seed.cart.collect()}
    exp_state, exp_rej = _cart_brute(init, stock, events)
    assert {(r["user_id"], r["product_id"]): r["quantity"] for r in state.collect()} == exp_state
    assert sorted(r["seq"] for r in rej.collect()) == exp_rej
    assert state.select("id").distinct().count() == state.count()


def test_cascade_leaves_no_orphans(fx):
    t = fx.tables()
    victim = t.products.agg(F.min("category_id").alias("id"))
    t2 = cascades.cascade_delete(t, "categories", victim)
    assert quality.check_references(t2).count() == 0


def test_seed_checkout_last_unit(spark):
    seed = seed_tables(spark)
    req = spark.createDataFrame([(5, 5, 1, "card", "4242"), (6, 6, None, "cash", None)],
                                "seq long, user_id long, address_id long, payment_method string, card_last4 string")
    res = checkout.checkout(seed, req)
    d = {r["user_id"]: r for r in res.decisions.collect()}
    assert d[5]["decision"] == "accepted" and d[6]["reason"] == "Insufficient stock"
    o = res.orders.collect()[0]
    assert o["id"] == 10005 and o["invoice_number"] == "INV-10005" and o["payment_status"] == "paid"
    assert {r["id"]: r["stock"] for r in res.stock.collect()}[6] == 0
    assert res.tables.cart.filter("user_id = 5").count() == 0


def test_review_submissions(fx):
    from souk.operators import reviews
    from souk.sources import feeds
    t = fx.tables()
    state, rej = reviews.apply_reviews(t, feeds.review_feed(fx))
    assert quality.check_unique(t.with_(reviews=state)).filter("table_name = 'reviews'").count() == 0
    assert state.filter("rating < 1 or rating > 5").count() == 0
    assert rej.count() + state.count() - t.reviews.count() == feeds.review_feed(fx).count()


def _contended(spark, rng, users, products=9, repeat=0.0):
    """Every cart wants product 1; some want others too; some users ask again later. Returns tables, requests, carts, stock."""
    seed = seed_tables(spark)
    stock = {1: len(users) // 2, **{p: rng.randint(0, 8) for p in range(2, products)}}
    price = {p: D("5.00") + p for p in stock}
    carts, cart_rows, cid = {}, [], 1
    for user in users:
        others = rng.sample(range(2, products), rng.randint(0, 2))
        carts[user] = [(1, rng.randint(1, 3), price[1])] + [(p, rng.randint(1, 2), price[p]) for p in others]
        for p, q, _ in carts[user]:
            cart_rows.append((cid, user, p, q))
            cid += 1
    prods = spark.createDataFrame(
        [(p, f"P{p}", "d", "i", price[p], stock[p], 1, 3, None) for p in stock], seed.products.schema)
    t = seed.with_(products=prods, cart=spark.createDataFrame(cart_rows, seed.cart.schema))
    asks = [*users, *[u for u in users if rng.random() < repeat]]
    first = asks[:len(users)]
    requests = [(i, u, None, "cash", None) for i, u in enumerate(first + rng.sample(asks[len(users):], len(asks) - len(users)))]
    req = spark.createDataFrame(requests, "seq long, user_id long, address_id long, payment_method string, card_last4 string")
    return t, req, requests, carts, stock


def _serve(requests, carts, stock):
    """The plain loop over requests: decision by seq, and the stock left."""
    stock, carts, out = dict(stock), dict(carts), {}
    for seq, user, *_ in requests:
        lines = carts.get(user, [])
        if not lines:
            out[seq] = "Cart is empty"
        elif all(q <= stock[p] for p, q, _ in lines):
            for p, q, _ in lines:
                stock[p] -= q
            carts[user], out[seq] = [], None
        else:
            out[seq] = "Insufficient stock"
    return out, stock


def test_checkout_hot_product_equals_sequential(spark):
    """300 carts that want the same hot product, a third of the users asking twice, against the plain loop."""
    t, req, requests, carts, stock = _contended(spark, random.Random(17), range(1000, 1300), repeat=0.3)
    res = checkout.checkout(t, req)
    want, left = _serve(requests, carts, stock)
    assert {r["seq"]: r["reason"] for r in res.decisions.collect()} == want and len(want) > 300
    assert {r["id"]: r["stock"] for r in res.stock.collect()} == left
    assert res.rounds <= 3
    for name, df in res.tables.items():  # numbered after each table's own largest id
        if name in ("orders", "order_items", "payments", "invoices"):
            ids = [r["id"] for r in df.select("id").collect()]
            assert len(ids) == len(set(ids)) and max(ids) - max(r["id"] for r in getattr(t, name).collect()) == len(ids) - getattr(t, name).count()


def test_checkout_blocks_and_components_change_nothing(spark):
    """Tiny blocks: prefixes of the request order, cut into components, several rounds; the same decisions."""
    rng = random.Random(23)
    lines, stock, carts = [], {}, {}
    for group in range(4):  # groups of carts that share no product
        products = [10 * group + p for p in range(3)]
        stock |= {p: rng.randint(2, 9) for p in products}
        for seq in range(group, 80, 4):
            carts[seq] = [(p, rng.randint(1, 3)) for p in rng.sample(products, rng.randint(1, 3))]
            lines += [(seq, p, q, stock[p]) for p, q in carts[seq]]
    want, left = {}, dict(stock)
    for seq in sorted(carts):
        want[seq] = "A" if all(q <= left[p] for p, q in carts[seq]) else "R"
        if want[seq] == "A":
            for p, q in carts[seq]:
                left[p] -= q
    df = spark.createDataFrame(lines, "seq long, product_id long, quantity int, stock int")
    for sizes in ((2, 9), (3, 1000)):
        status, _ = checkout.decide(df, *sizes)
        assert {r["seq"]: r["status"] for r in status.collect()} == want


def test_checkout_forms(spark):
    """Address upsert, card check and payment default around the order, as the checkout page does."""
    seed = seed_tables(spark)
    forms = [(1, 5, " 555 123 4567 ", "Town", "9 New Rd", "paypal", None), (2, 6, "555-765-4321", "City", "1 First St", "card", "4111 1111 1111 1111"),
             (3, 6, "555-765-4321", "City", "1 First St", "card", "4111 1111 1111 1112"), (4, 1, "", "x", "y", "cash", None), (5, 1, "12", "x", "y", "cash", None),
             (6, 5, "555 999 9999", "Other", "2 Late St", "cash", None)]
    seed = seed.with_(products=seed.products.withColumn("stock", F.lit(5)))
    done, rejects = checkout.serve_forms(seed, spark.createDataFrame(
        forms, "seq long, user_id long, phone string, city string, address string, payment_method string, card_number string"))
    assert {r["seq"]: r["reason"] for r in rejects.collect()} == {3: checkout.MSG_CARD, 4: changes.MSG_ADDRESS, 5: changes.MSG_PHONE}
    assert {r["seq"]: r["reason"] for r in done.decisions.collect()} == {1: None, 2: None, 6: "Cart is empty"}
    orders = {r["user_id"]: r for r in done.orders.collect()}
    assert orders[5]["delivery_address_id"] == 1 and orders[6]["delivery_address_id"] == 3
    assert (orders[5]["payment_method"], orders[6]["payment_method"], orders[6]["card_last4"]) == ("cash", "card", "1111")
    saved = {r["id"]: r for r in done.tables.user_addresses.collect()}
    assert saved[1]["address"] == "9 New Rd" and saved[3]["city"] == "City"
    placed = {r["id"]: r["delivery_address_id"] for r in done.tables.orders.collect()}
    assert placed[10005] == 1 and placed[10006] == 3


def test_as_of_join_equals_a_scan(spark):
    from souk.plans.asof import values_as_of

    rng = random.Random(8)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(60)) for i in range(400)]
    versions = [(rng.choice([1, 1, 2, 4, None]), rng.randrange(60), rng.choice([None, *range(9)])) for _ in range(80)]
    left, right = spark.createDataFrame(rows, "i long, k long, at long"), spark.createDataFrame(versions, "k long, at long, v long")

    def latest(k, at):  # NULL values sort first, as in Spark
        past = [(a, v is not None, v or 0, v) for kk, a, v in versions if k is not None and kk == k and a <= at]
        return max(past, key=lambda p: p[:3])[3] if past else None

    want = sorted((i, latest(k, at)) for i, k, at in rows if latest(k, at) is not None)
    for buckets in (1, 7, 64):
        got = values_as_of(left, right, ["k"], ["at"], ["v"], buckets=buckets)
        assert got.count() == len(rows)
        assert sorted((r["i"], r["v"]) for r in got.collect() if r["v"] is not None) == want
    assert values_as_of(left, right.limit(0), ["k"], ["at"], ["v"]).filter("v is not null").count() == 0
