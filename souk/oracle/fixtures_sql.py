"""The test-data mapping as DuckDB CTE text (mirror of ``souk.sources.fixtures``
and ``souk.sources.feeds``).

Marketplace tables are named ``m_*`` and change feeds ``f_*`` so they never
shadow the driver's views (``orders`` exists there with TPC-H columns).
"""

from __future__ import annotations

import re

EPOCH = "DATE '1995-01-01'"


def _days(expr: str) -> str:
    return f"CAST({EPOCH} + CAST({expr} AS INTEGER) AS TIMESTAMP)"


def _email(col: str) -> str:
    return f"lower(replace({col}, '#', '.')) || '@example.com'"


def _phone(k: str) -> str:
    d = f"substr('55501' || lpad(CAST({k} AS VARCHAR), 11, '0'), 1, CAST(8 + {k} % 9 AS INTEGER))"
    return f"(substr({d}, 1, 3) || ' ' || substr({d}, 4, 3) || '-' || substr({d}, 7, 100))"


def _invoice(col: str) -> str:
    s = f"CAST({col} AS VARCHAR)"
    return f"('INV-' || lpad({s}, CAST(greatest(4, length({s})) AS INTEGER), '0'))"


CTES: dict[str, str] = {}

CTES["m_users"] = f"""
SELECT c_custkey AS id, c_name AS name, {_email('c_name')} AS email, 'customer' AS role,
       CASE WHEN c_acctbal < 0 THEN 'suspended' ELSE 'active' END AS account_status,
       {_days('c_custkey % 1000')} AS created_at
FROM customer
UNION ALL
SELECT 1000000000 + s_suppkey, s_name, {_email('s_name')}, 'seller', 'active', {_days('s_suppkey % 1000')}
FROM supplier"""

CTES["m_categories"] = """
SELECT CAST(dense_rank() OVER (ORDER BY name) AS BIGINT) AS id, name
FROM (SELECT DISTINCT p_type AS name FROM part)
UNION ALL SELECT CAST(0 AS BIGINT), 'UNLISTED'"""

CTES["m_product_cols"] = f"""
SELECT p_partkey AS id, p_name AS name,
       p_brand || ' ' || p_type || ' size ' || CAST(p_size AS VARCHAR) AS description,
       CASE WHEN p_size % 7 = 0 THEN ''
            WHEN p_size % 5 = 0 THEN '/img/' || CAST(p_partkey AS VARCHAR) || '.jpg'
            ELSE 'img/' || CAST(p_partkey AS VARCHAR) || '.jpg' END AS image_url,
       CAST(p_retailprice AS DECIMAL(10,2)) AS price,
       CAST(CASE WHEN p_partkey % 25 = 0 THEN 0 ELSE 20 + (p_partkey * 37) % 381 END AS INTEGER) AS stock,
       p_type AS category_name,
       1000000000 + p_partkey % ((SELECT count(*) FROM supplier) - 1) AS seller_id,
       {_days('p_partkey % 500')} AS created_at
FROM part"""

CTES["m_products"] = """
SELECT pc.id, pc.name, pc.description, pc.image_url, pc.price, pc.stock, c.id AS category_id, pc.seller_id,
       pc.created_at
FROM m_product_cols pc JOIN m_categories c ON c.name = pc.category_name"""

CTES["m_orders"] = """
SELECT o_orderkey AS id, o_custkey AS user_id,
       CASE WHEN o_custkey % 10 <> 0 THEN o_custkey * 2 END AS delivery_address_id,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'cancelled'
            WHEN o_orderstatus = 'P' THEN 'pending'
            WHEN o_orderstatus = 'O' THEN 'completed'
            WHEN o_orderstatus = 'F' THEN 'delivered' END AS status,
       o_orderdate AS created_at
FROM orders"""

CTES["m_items"] = """
SELECT l_orderkey * 1000000 + l_partkey AS id, l_orderkey AS order_id, l_partkey AS product_id,
       CAST(floor(sum(l_quantity)) AS INTEGER) AS quantity,
       min(CAST(l_extendedprice AS DECIMAL(10,2))) AS price
FROM lineitem GROUP BY l_orderkey, l_partkey"""

CTES["m_addresses"] = f"""
SELECT c_custkey * 2 AS id, c_custkey AS user_id, {_phone('c_custkey')} AS phone, n_name AS city,
       'Street ' || CAST(c_custkey AS VARCHAR) AS address, (c_custkey % 3 <> 0) AS is_default,
       {_days('c_custkey % 1000')} AS created_at
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 10 <> 0
UNION ALL
SELECT c_custkey * 2 + 1, c_custkey, {_phone('c_custkey')}, n_name, 'Street ' || CAST(c_custkey AS VARCHAR),
       (c_custkey % 8 = 0), {_days('c_custkey % 1000')}
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 4 = 0"""

CTES["m_payments"] = """
SELECT o_orderkey AS id, o_orderkey AS order_id,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'card' ELSE 'cash' END AS payment_method,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
            THEN lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') END AS card_last4,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'paid' ELSE 'pending' END AS payment_status,
       o_orderdate AS created_at
FROM orders WHERE o_orderkey % 20 <> 19"""

CTES["m_invoices"] = f"""
SELECT o_orderkey AS id, o_orderkey AS order_id, {_invoice('o_orderkey')} AS invoice_number,
       o_orderdate AS issued_at
FROM orders WHERE o_orderkey % 25 <> 24"""

CTES["m_reviews"] = """
SELECT order_id * 1000000 + product_id AS id, user_id, product_id,
       CAST(1 + (order_id + product_id) % 5 AS INTEGER) AS rating,
       'Review of product ' || CAST(product_id AS VARCHAR) AS comment,
       created_at + INTERVAL 7 DAY AS created_at
FROM (
  SELECT o.user_id, i.product_id, i.order_id, o.created_at,
         row_number() OVER (PARTITION BY o.user_id, i.product_id ORDER BY i.order_id) AS rn
  FROM m_items i JOIN m_orders o ON o.id = i.order_id
  WHERE o.status = 'delivered' AND (i.order_id * 31 + i.product_id) % 3 = 0)
WHERE rn = 1"""

CTES["m_cart"] = """
SELECT i.order_id * 1000000 + i.product_id AS id, lp.user_id, i.product_id, i.quantity
FROM m_items i
JOIN (SELECT user_id, max(id) AS order_id FROM m_orders WHERE status = 'pending' GROUP BY user_id) lp
  ON lp.order_id = i.order_id"""

# Derived views shared by many oracle queries.
CTES["v_order_totals"] = """
SELECT order_id, subtotal, CAST(10.00 AS DECIMAL(38,2)) AS delivery_fee,
       CAST(round(subtotal * 0.05, 2) AS DECIMAL(38,2)) AS tax_amount,
       CAST(subtotal + 10.00 + round(subtotal * 0.05, 2) AS DECIMAL(38,2)) AS total_amount
FROM (SELECT oi.order_id, CAST(sum(oi.quantity * oi.price) AS DECIMAL(38,2)) AS subtotal
      FROM m_items oi WHERE oi.order_id IN (SELECT id FROM m_orders) GROUP BY oi.order_id)"""

# Line amounts and per-product sums: the reports' oracles start from these, dimensions are looked up last.
CTES["v_lines"] = """
SELECT product_id, order_id, quantity, quantity * price AS amount,
       order_id IN (SELECT id FROM m_orders) AS placed,
       order_id IN (SELECT id FROM m_orders WHERE status <> 'cancelled') AS live
FROM m_items"""

CTES["v_product_sales"] = """
SELECT product_id, count(*) AS n, count(*) FILTER (placed) AS n_placed, count(*) FILTER (live) AS n_live,
       sum(quantity) AS units, sum(amount) AS amount,
       coalesce(sum(quantity) FILTER (live), 0) AS live_units, coalesce(sum(amount) FILTER (live), 0) AS live_amount
FROM v_lines GROUP BY product_id"""

CTES["v_product_stars"] = """
SELECT product_id, count(rating) AS n, sum(rating) AS s FROM m_reviews GROUP BY product_id"""

CTES["v_rating_summary"] = """
SELECT p.id AS product_id, CAST(coalesce(r.n, 0) AS BIGINT) AS review_count,
       CAST(CASE WHEN coalesce(r.nr, 0) > 0
                 THEN ((200 * CAST(r.s AS HUGEINT) + r.nr) // (2 * r.nr)) / 100
                 ELSE 0 END AS DECIMAL(3,2)) AS average_rating
FROM m_products p
LEFT JOIN (SELECT product_id, count(id) AS n, count(rating) AS nr, sum(rating) AS s
           FROM m_reviews GROUP BY product_id) r ON r.product_id = p.id"""


def register(name: str, body: str) -> None:
    CTES[name] = body


def with_ctes(query: str) -> str:
    """Prefix ``query`` with the CTEs it references, dependencies first."""
    names = list(CTES)
    pattern = {n: re.compile(r"\b" + re.escape(n) + r"\b") for n in names}
    needed: list[str] = []

    def visit(text: str):
        for n in names:
            if n not in needed and pattern[n].search(text):
                visit(CTES[n])
                if n not in needed:
                    needed.append(n)

    visit(query)
    q = query.strip()
    if not needed:
        return q
    body = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in needed)
    m = re.match(r"(?is)^WITH\s+(RECURSIVE\s+)?", q)
    if m:
        return f"WITH {m.group(1) or ''}{body},\n{q[m.end():]}"
    return f"WITH {body}\n{q}"


# ---------------------------------------------------------------- change feeds
CTES["f_catalog"] = """
SELECT id AS seq, name, description, image_url, price, stock,
       CASE WHEN id % 15 = 0 THEN 'NO_SUCH' WHEN id % 4 = 0 THEN lower(category_name)
            WHEN id % 4 = 1 THEN upper(category_name)
            WHEN id % 4 = 2 THEN translate(category_name, 'AEOaeo', 'ÁÉÖáéö') || ' ' ELSE category_name END AS category_name, seller_id
FROM m_product_cols"""

CTES["f_products"] = """
SELECT id * 4 + nth AS seq,
       CASE WHEN nth = 2 THEN 'delete' WHEN nth > 0 THEN 'update'
            ELSE CASE id % 10 WHEN 0 THEN 'delete' WHEN 2 THEN 'add' ELSE 'update' END END AS op,
       CASE WHEN id % 10 = 2 THEN id + (SELECT count(*) FROM part) ELSE id END AS product_id,
       name, description, image_url,
       CAST(CASE WHEN id % 40 = 1 THEN 0 ELSE price + nth END AS DECIMAL(10,2)) AS price,
       CASE WHEN id % 7 <> 0 AND id % 7 <> 1 AND id % 70 = 2 THEN 0 ELSE stock END AS stock,  -- what an (int) cast reads
       CASE WHEN id % 10 = 2 AND id % 50 = 2 THEN CAST(999999 AS BIGINT) ELSE category_id END AS category_id,
       CASE WHEN id % 30 = 11 THEN seller_id + 1 ELSE seller_id END AS seller_id
FROM m_products, range(4) r(nth)
WHERE nth = 0 OR (nth = 1 AND id % 3 = 0) OR (nth = 2 AND id % 5 = 0) OR (nth = 3 AND id % 15 = 0)"""

CTES["f_categories"] = """
SELECT p_partkey * 3 AS seq, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand)
                                  WHEN p_partkey % 3 = 0 THEN translate(p_brand, 'AEOaeo', 'ÁÉÖáéö') || ' ' ELSE p_brand END AS name FROM part
UNION ALL SELECT p_partkey * 3 + 1, CASE WHEN p_partkey % 5 = 0 THEN translate(p_type, 'AEOaeo', 'ÁÉÖáéö') || ' ' ELSE p_type END FROM part
UNION ALL SELECT p_partkey * 3 + 2, '  ' FROM part WHERE p_partkey % 100 = 0"""

CTES["f_users"] = """
SELECT c_custkey AS seq, c_custkey AS user_id,
       ['seller', 'customer', 'owner'][c_custkey % 3 + 1] AS role,
       ['active', 'suspended', 'pending', 'gone'][c_custkey % 4 + 1] AS account_status
FROM customer"""

CTES["f_order_status"] = """
SELECT id AS seq, id AS order_id,
       ['cancelled', 'delivered', 'shipped', 'completed', 'pending'][id % 5 + 1] AS status
FROM m_orders"""

CTES["f_reviews"] = """
SELECT i.order_id * 1000000 + i.product_id AS seq, o.user_id, i.product_id,
       CAST((i.order_id + i.product_id) % 9 - 1 AS INTEGER) AS rating,
       '  Liked item ' || CAST(i.product_id AS VARCHAR) || chr(9) AS comment
FROM m_items i JOIN m_orders o ON o.id = i.order_id"""

CTES["f_review_changes"] = """
SELECT created_at AS changed_at, 'INSERT' AS op, id AS review_id, product_id, rating, 1 AS sign FROM m_reviews
UNION ALL
SELECT created_at + INTERVAL 30 DAY, 'DELETE', id, product_id, rating, -1 FROM m_reviews WHERE id % 4 = 0"""

CTES["f_cart"] = """
SELECT event_id AS seq, ts AS requested_at, user_id,
       CASE event_type WHEN 'view' THEN 'set' WHEN 'error' THEN 'remove' ELSE 'add' END AS op,
       CASE WHEN event_type = 'signup' THEN event_id % (SELECT count(*) FROM part) + (SELECT count(*) FROM part)
            ELSE (event_id * 7) % (SELECT count(*) FROM part) END AS product_id,
       CAST(floor(value) AS INTEGER) AS quantity
FROM events"""

CTES["v_default_address"] = """
SELECT user_id, id, phone, city, address, is_default, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id
                               ORDER BY CASE WHEN is_default THEN 0 WHEN NOT is_default THEN 1 ELSE 2 END, id) AS rn
  FROM m_addresses) WHERE rn = 1"""

CTES["f_checkout_first"] = """
SELECT co.user_id * 2 AS seq, co.user_id, da.id AS address_id,
       CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'card' ELSE 'cash' END AS payment_method,
       CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH')
            THEN right(CAST(4000000000000000 + co.user_id * 7 AS VARCHAR), 4) END AS card_last4
FROM (SELECT user_id, max(id) AS oid FROM m_orders WHERE status = 'pending' GROUP BY user_id) co
JOIN orders o ON o.o_orderkey = co.oid
LEFT JOIN v_default_address da ON da.user_id = co.user_id
WHERE co.user_id IN (SELECT user_id FROM m_cart)"""

CTES["f_checkout"] = """
SELECT * FROM f_checkout_first
UNION ALL SELECT * REPLACE (seq + 1 AS seq) FROM f_checkout_first WHERE user_id % 6 = 0
UNION ALL SELECT * REPLACE (seq + 1000000000000 AS seq) FROM f_checkout_first WHERE user_id % 10 = 0"""

CTES["f_order_events"] = """
SELECT id AS order_id, 'pending' AS status, created_at AS event_time, created_at FROM m_orders
UNION ALL
SELECT id, 'completed', created_at + INTERVAL 1 HOUR, created_at FROM m_orders
WHERE status <> 'pending' AND NOT (status = 'cancelled' AND id % 3 = 0)
UNION ALL
SELECT id, status, created_at + CASE WHEN status = 'cancelled' AND id % 3 = 0 THEN INTERVAL 30 SECOND
                                     WHEN id % 4 = 1 THEN INTERVAL 10 DAY ELSE INTERVAL 1 DAY END, created_at
FROM m_orders WHERE status IN ('delivered', 'cancelled')"""

CTES["f_contacts"] = f"""
SELECT c_custkey AS user_id, {_phone('c_custkey')} AS phone,
       CAST(4000000000000000 + c_custkey * 7 AS VARCHAR) AS card_number,
       CASE c_custkey % 11 WHEN 0 THEN replace({_email('c_name')}, '@', '') WHEN 1 THEN replace({_email('c_name')}, '@', '..b@')
            WHEN 2 THEN '.' || {_email('c_name')} WHEN 3 THEN replace({_email('c_name')}, '@', '.@')
            WHEN 4 THEN repeat('a', 65) || '@example.com' ELSE {_email('c_name')} END AS email,
       c_custkey AS seq
FROM customer"""

CTES["f_addresses"] = """
SELECT seq, user_id, ' ' || phone || '  ' AS phone, 'Town ' || CAST(user_id % 7 AS VARCHAR) AS city,
       'Avenue ' || CAST(user_id AS VARCHAR) || chr(10) AS address
FROM f_contacts"""
