"""The cascade closure against a plain walk of the foreign keys, and the paged order lines."""

from graphlib import CycleError

import pytest

from souk.operators import cascades, listings
from souk.sources.schema import CASCADE, FOREIGN_KEYS, SET_NULL, TABLE_NAMES
from souk.sources.tables import Tables


def _walk(rows, table, ids):
    """Brute force over lists of dicts: deleted (table, id) and (table, id, column) set to NULL."""
    dead = {(table, r["id"]) for r in rows[table] if r["id"] in ids}
    while True:
        more = {(c, r["id"]) for c, col, p, a in FOREIGN_KEYS if a == CASCADE for r in rows[c] if (p, r[col]) in dead} - dead
        if not more:
            break
        dead |= more
    lost = {(c, r["id"], col) for c, col, p, a in FOREIGN_KEYS if a == SET_NULL for r in rows[c]
            if (p, r[col]) in dead and (c, r["id"]) not in dead}
    return dead, lost


@pytest.mark.parametrize("table, ids", [("users", [4, 5, 5, None, 777]), ("users", [1, 2, 3, 4, 5, 6]), ("categories", [1, 5]),
                                        ("products", [6, 1]), ("orders", [10001]), ("user_addresses", [1]), ("reviews", [1]), ("users", [])])
def test_closure_equals_a_walk(spark, seed, table, ids):
    rows = {n: [r.asDict() for r in getattr(seed, n).collect()] for n in TABLE_NAMES}
    dead, lost = _walk(rows, table, ids)
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    got = [tuple(r) for r in cascades.cascade_rows(seed, table, frame).collect()]
    assert len(got) == len(set(got))
    assert {g[:2] for g in got if g[2] == "deleted"} == dead
    assert {(g[0], g[1], g[3]) for g in got if g[2] == "set null"} == lost
    after = cascades.cascade_delete(seed, table, frame)
    for n in TABLE_NAMES:
        left = [{**r, **{c: None for t, i, c in lost if (t, i) == (n, r["id"])}} for r in rows[n] if (n, r["id"]) not in dead]
        assert sorted(map(repr, (r.asDict() for r in getattr(after, n).collect()))) == sorted(map(repr, left))


def test_own_keys_and_circles(spark, seed):
    frame = spark.createDataFrame([(1,)], "id long")
    keys = (("cart", "user_id", "users", SET_NULL),)
    got = cascades.cascade_rows(seed, "users", frame, keys).collect()
    assert {r["table_name"] for r in got if r["effect"] == "deleted"} == {"users"}
    with pytest.raises(CycleError):
        cascades.cascade_rows(seed, "users", frame, FOREIGN_KEYS + (("users", "id", "orders", CASCADE),))


def test_pages_hold_at_most_so_many_lines(spark, seed):
    items = spark.createDataFrame([(i, 1 if i <= 250 else i, 1 + i % 2, i % 5 + 1) for i in range(1, 260)] + [(999, 1, 12345, 1)],
                                  "id long, order_id long, product_id long, quantity int").selectExpr("*", "cast(1 as decimal(10,2)) price")
    t: Tables = seed.with_(order_items=items)
    pages = listings.order_item_pages(t, page_lines=40).collect()
    big = sorted((p["page"], p["n_lines"], [ln["line"] for ln in p["lines"]]) for p in pages if p["order_id"] == 1)
    assert [b[:2] for b in big] == [(i, 40) for i in range(1, 7)] + [(7, 10)]
    assert sum((b[2] for b in big), []) == list(range(1, 251))  # the line of an unknown product has no place
    assert len(pages) == 7 + 9 and listings.unnest_pages(listings.order_item_pages(t)).count() == 259
    assert listings.order_item_pages(seed, user_id=-1).count() == 0
