"""DuckDB oracle SQL, one statement per registered query key.

A second derivation of every result from the rules (Q1-Q12): per-product and per-order sums come first, dimensions
are looked up afterwards by scalar subqueries, sets are differences of pairs. Output casts are the Spark
code's: money DECIMAL(38,2), counts BIGINT, ratings DECIMAL(3,2) by exact half-up integer division. Message texts are
the marked constants of the operators.
"""

from __future__ import annotations

from souk.operators import changes, checkout, reviews
from souk.oracle.fixtures_sql import with_ctes
from souk.streaming import streams

M = "DECIMAL(38,2)"

SQL: dict[str, str] = {}

# ---------------------------------------------------------------- reports
SQL["order_totals"] = "SELECT * FROM v_order_totals"

SQL["daily_sales"] = f"""
WITH sums AS (SELECT order_id, sum(amount) AS subtotal FROM v_lines WHERE live GROUP BY order_id),
dated AS (
  SELECT (SELECT CAST(created_at AS DATE) FROM m_orders WHERE id = order_id) AS order_date,
         subtotal, round(subtotal * 0.05, 2) AS tax
  FROM sums)
SELECT order_date, count(*) AS total_orders, CAST(sum(subtotal) AS {M}) AS subtotal,
       CAST(10.00 * count(*) AS {M}) AS delivery_fees, CAST(sum(tax) AS {M}) AS taxes,
       CAST(sum(subtotal) + sum(tax) + 10.00 * count(*) AS {M}) AS revenue
FROM dated GROUP BY ALL"""

SQL["sales_summary"] = f"""
WITH sums AS (SELECT order_id, sum(amount) AS subtotal FROM v_lines WHERE live GROUP BY order_id),
cents AS (SELECT count(*) AS n, coalesce(sum(CAST(100 * (subtotal + round(subtotal * 0.05, 2) + 10) AS HUGEINT)), 0) AS c FROM sums)
SELECT n AS total_orders, CAST(c / CAST(100 AS {M}) AS {M}) AS revenue,
       CAST(CASE WHEN n = 0 THEN 0 ELSE ((2 * c + n) // (2 * n)) / CAST(100 AS {M}) END AS {M}) AS avg_order
FROM cents"""

SQL["top_products"] = f"""
SELECT product_id, (SELECT name FROM m_products WHERE id = product_id) AS name,
       CAST(live_units AS BIGINT) AS units_sold, CAST(live_amount AS {M}) AS revenue
FROM v_product_sales
WHERE n_live > 0 AND product_id IN (SELECT id FROM m_products)
QUALIFY row_number() OVER (ORDER BY live_units DESC, product_id) <= 10"""

SQL["rating_summary"] = "SELECT * FROM v_rating_summary"

SQL["product_average_rating"] = "SELECT product_id, average_rating FROM v_rating_summary"

SQL["category_product_counts"] = """
SELECT id, name, CAST((SELECT count(*) FROM m_products WHERE category_id = m_categories.id) AS BIGINT) AS product_count
FROM m_categories"""

SQL["seller_sales"] = """
WITH owned AS (SELECT (SELECT seller_id FROM m_products WHERE id = product_id) AS seller, n_placed FROM v_product_sales)
SELECT id, name, CAST(coalesce((SELECT sum(n_placed) FROM owned WHERE seller = m_users.id), 0) AS BIGINT) AS total_orders
FROM m_users WHERE role = 'seller'"""

SQL["seller_revenue"] = f"""
WITH owned AS (SELECT (SELECT seller_id FROM m_products WHERE id = product_id) AS seller, units AS units, amount AS amount FROM v_product_sales),
bought AS (
  SELECT DISTINCT (SELECT seller_id FROM m_products WHERE id = product_id) AS seller, order_id FROM v_lines WHERE live)
SELECT id AS seller_id, name AS seller_name,
       (SELECT count(*) FROM bought WHERE seller = m_users.id) AS orders_count,
       CAST(coalesce((SELECT sum(units) FROM owned WHERE seller = m_users.id), 0) AS BIGINT) AS units_sold,
       CAST(coalesce((SELECT sum(amount) FROM owned WHERE seller = m_users.id), 0) AS {M}) AS seller_revenue
FROM m_users WHERE role = 'seller'"""

SQL["seller_revenue_net"] = f"""
WITH owned AS (SELECT (SELECT seller_id FROM m_products WHERE id = product_id) AS seller, live_units AS units, live_amount AS amount FROM v_product_sales),
bought AS (
  SELECT DISTINCT (SELECT seller_id FROM m_products WHERE id = product_id) AS seller, order_id FROM v_lines WHERE live)
SELECT id AS seller_id, name AS seller_name,
       (SELECT count(*) FROM bought WHERE seller = m_users.id) AS orders_count,
       CAST(coalesce((SELECT sum(units) FROM owned WHERE seller = m_users.id), 0) AS BIGINT) AS units_sold,
       CAST(coalesce((SELECT sum(amount) FROM owned WHERE seller = m_users.id), 0) AS {M}) AS seller_revenue
FROM m_users WHERE role = 'seller'"""

SQL["category_revenue"] = f"""
WITH filed AS (
  SELECT category_id, greatest(1, coalesce((SELECT n FROM v_product_sales WHERE product_id = id), 0)) AS n,
         (SELECT amount FROM v_product_sales WHERE product_id = id) AS amount
  FROM m_products)
SELECT id AS category_id, name, CAST(coalesce((SELECT sum(n) FROM filed WHERE category_id = m_categories.id), 0) AS BIGINT) AS product_count,
       CAST(coalesce((SELECT sum(amount) FROM filed WHERE category_id = m_categories.id), 0) AS {M}) AS revenue
FROM m_categories"""

SQL["category_revenue_net"] = f"""
WITH filed AS (
  SELECT category_id, (SELECT live_amount FROM v_product_sales WHERE product_id = id) AS amount FROM m_products)
SELECT id AS category_id, name, CAST((SELECT count(*) FROM filed WHERE category_id = m_categories.id) AS BIGINT) AS product_count,
       CAST(coalesce((SELECT sum(amount) FROM filed WHERE category_id = m_categories.id), 0) AS {M}) AS revenue
FROM m_categories"""

SQL["cart_totals"] = f"""
SELECT user_id, items, units, subtotal, CAST(10.00 AS {M}) AS delivery_fee,
       CAST(round(subtotal * 0.05, 2) AS {M}) AS tax_amount,
       CAST(subtotal + 10.00 + round(subtotal * 0.05, 2) AS {M}) AS total_amount
FROM (SELECT c.user_id, count(*) AS items, CAST(sum(c.quantity) AS BIGINT) AS units,
             CAST(sum(c.quantity * p.price) AS {M}) AS subtotal
      FROM m_cart c JOIN m_products p ON p.id = c.product_id GROUP BY c.user_id)"""



# ---------------------------------------------------------------- helpers
def ptrim(x: str) -> str:
    """PHP trim() as DuckDB SQL."""
    return rf"regexp_replace({x}, '^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$', '', 'g')"


def avg4(s: str, n: str) -> str:
    """AVG over INT at four decimals, half up, exact; 0 when there are none."""
    return (f"CAST(CASE WHEN {n} > 0 THEN ((20000 * CAST({s} AS HUGEINT) + {n}) // (2 * {n})) "
            f"/ CAST(10000 AS DECIMAL(10,0)) ELSE 0 END AS DECIMAL(5,4))")


T0 = "TIMESTAMP '2000-01-01 00:00:00'"

# ---------------------------------------------------------------- catalog
# Look-ups from a row of m_products.
CATEGORY = "(SELECT c.name FROM m_categories c WHERE c.id = category_id)"
SELLER = "(SELECT u.name FROM m_users u WHERE u.id = seller_id)"
KNOWN = "category_id IN (SELECT id FROM m_categories) AND seller_id IN (SELECT id FROM m_users)"
STARS = avg4("coalesce((SELECT s FROM v_product_stars WHERE product_id = m_products.id), 0)",
             "coalesce((SELECT n FROM v_product_stars WHERE product_id = m_products.id), 0)")

SQL["product_catalog"] = f"""
SELECT id, name, description, image_url, price, stock, {CATEGORY} AS category_name
FROM m_products WHERE category_id IN (SELECT id FROM m_categories)"""

SQL["product_catalog_full"] = f"""
SELECT id, name, description, image_url, price, stock, {CATEGORY} AS category_name, {SELLER} AS seller_name,
       coalesce((SELECT average_rating FROM v_rating_summary WHERE product_id = id), CAST(0 AS DECIMAL(3,2))) AS average_rating,
       coalesce((SELECT review_count FROM v_rating_summary WHERE product_id = id), 0) AS review_count
FROM m_products WHERE {KNOWN}"""

_SEARCH = f"""
SELECT id, name, description, price, stock, image_url, {CATEGORY} AS category_name, {SELLER} AS seller_name,
       {STARS} AS avg_rating, created_at
FROM m_products WHERE {KNOWN} AND {{where}}"""

SQL["catalog_search"] = _SEARCH.format(where="contains(lower(name), 'red')")

SQL["catalog_search_indexed"] = SQL["catalog_search"]
SQL["catalog_search_indexed_wildcards"] = _SEARCH.format(where="regexp_matches(lower(name), 'red.*wid.et')")
SQL["catalog_search_category"] = _SEARCH.format(where="category_id = 1")
SQL["catalog_search_both"] = _SEARCH.format(where="contains(lower(name), 'red') AND category_id = 1")

SQL["seller_catalog"] = f"""
SELECT id, name, description, image_url, price, stock, category_id, {CATEGORY} AS category_name, seller_id, created_at,
       {STARS} AS avg_rating
FROM m_products WHERE category_id IN (SELECT id FROM m_categories)"""

SQL["catalog_card"] = f"""
SELECT id, name, category_name, seller_name, price, stock,
       regexp_replace(CASE WHEN coalesce(image_url, '') IN ('', '0')
                           THEN 'assets/images/products/blue_bow_blouse.jfif' ELSE image_url END,
                      '^/+', '') AS image_path,
       stock > 0 AS in_stock,
       CAST(round(avg_rating, 1) AS DECIMAL(2,1)) AS rating_display
FROM ({_SEARCH.format(where="TRUE")})"""

SQL["catalog_feed_load"] = """
SELECT f.category_name, f.seq, f.name, f.description, f.image_url, f.price, f.stock, f.seller_id,
       c.id AS category_id
FROM f_catalog f, m_categories c WHERE rtrim(strip_accents(lower(c.name))) = rtrim(strip_accents(lower(f.category_name)))"""

SQL["catalog_feed_rejects"] = """
SELECT f.*, 'unknown category' AS reason FROM f_catalog f
WHERE rtrim(strip_accents(upper(f.category_name))) NOT IN (SELECT rtrim(strip_accents(upper(name))) FROM m_categories)"""

SQL["catalog_reload"] = f"""
SELECT row_number() OVER (ORDER BY f.seq) AS id, {ptrim('f.name')} AS name, f.description, f.image_url, f.price,
       f.stock, c.id AS category_id, f.seller_id, {T0} AS created_at
FROM f_catalog f, m_categories c WHERE rtrim(strip_accents(upper(c.name))) = rtrim(strip_accents(upper(f.category_name)))"""

# ---------------------------------------------------------------- listings
SQL["user_listing"] = "SELECT id, name, email, role, account_status, created_at FROM m_users"
SQL["category_listing"] = "SELECT id, name FROM m_categories"
SQL["default_address"] = "SELECT * FROM v_default_address"

SQL["cart_lines"] = f"""
SELECT id, user_id, product_id, quantity, shelf.name, shelf.price, shelf.stock, shelf.image_url,
       CAST(quantity * shelf.price AS {M}) AS line_total
FROM (SELECT *, (SELECT struct_pack(name := name, price := price, stock := stock, image_url := image_url)
                 FROM m_products WHERE m_products.id = product_id) AS shelf FROM m_cart)
WHERE shelf IS NOT NULL"""

SQL["cart_stock_violations"] = """
SELECT c.id, c.user_id, c.product_id, c.quantity, p.stock
FROM m_cart c JOIN m_products p ON p.id = c.product_id WHERE c.quantity > p.stock"""

SQL["blocked_carts"] = """
SELECT user_id FROM (SELECT user_id, quantity - (SELECT stock FROM m_products WHERE m_products.id = product_id) AS too_many FROM m_cart)
GROUP BY user_id HAVING max(too_many) > 0"""

SQL["order_history"] = f"""
WITH facts AS (
  SELECT id, user_id, status, created_at FROM m_orders
  UNION ALL BY NAME SELECT order_id AS id, subtotal, delivery_fee, tax_amount, total_amount FROM v_order_totals
  UNION ALL BY NAME SELECT order_id AS id, payment_method, card_last4, payment_status FROM m_payments
  UNION ALL BY NAME SELECT order_id AS id, invoice_number FROM m_invoices)
SELECT id, any_value(user_id) AS user_id,
       CAST(coalesce(any_value(subtotal), 0) AS {M}) AS subtotal, CAST(coalesce(any_value(delivery_fee), 10) AS {M}) AS delivery_fee,
       CAST(coalesce(any_value(tax_amount), 0) AS {M}) AS tax_amount, CAST(coalesce(any_value(total_amount), 0) AS {M}) AS total_amount,
       any_value(status) AS status, any_value(payment_method) AS payment_method, any_value(card_last4) AS card_last4,
       any_value(created_at) AS created_at, coalesce(any_value(payment_status), 'pending') AS payment_status,
       any_value(invoice_number) AS invoice_number
FROM facts GROUP BY id HAVING id IN (SELECT id FROM m_orders)"""

SQL["order_item_lines"] = """
SELECT order_id, product_id, (SELECT name FROM m_products WHERE id = product_id) AS name, quantity, price
FROM m_items WHERE product_id IN (SELECT id FROM m_products)"""

SQL["order_item_pages"] = """
WITH placed AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY id) AS line
                FROM m_items WHERE product_id IN (SELECT id FROM m_products)),
paged AS (SELECT *, (line + 2) // 3 AS page FROM placed)
SELECT order_id, page, count(*) OVER (PARTITION BY order_id, page) AS n_lines, line, product_id,
       (SELECT name FROM m_products WHERE id = product_id) AS name, quantity, price
FROM paged"""

SQL["admin_order_listing"] = f"""
SELECT id, status, created_at, (SELECT name FROM m_users WHERE m_users.id = user_id) AS customer_name,
       CAST(coalesce((SELECT total_amount FROM v_order_totals WHERE order_id = m_orders.id), 0) AS {M}) AS total_amount
FROM m_orders WHERE user_id IN (SELECT id FROM m_users)"""

SQL["admin_product_listing"] = f"""
SELECT id, name, price, stock, image_url, {CATEGORY} AS category_name, {SELLER} AS seller_name, created_at
FROM m_products WHERE {KNOWN}"""

_PRODUCT_NAME = "(SELECT name FROM m_products WHERE m_products.id = product_id)"

SQL["admin_review_listing"] = f"""
SELECT id, rating, comment, created_at, (SELECT name FROM m_users WHERE m_users.id = user_id) AS customer_name,
       {_PRODUCT_NAME} AS product_name
FROM m_reviews WHERE user_id IN (SELECT id FROM m_users) AND product_id IN (SELECT id FROM m_products)"""

# ---------------------------------------------------------------- reviews
SQL["reviewable_products"] = """
WITH pairs AS (
  SELECT o.user_id, i.product_id FROM m_items i JOIN m_orders o ON o.id = i.order_id AND o.status = 'delivered'
  WHERE i.product_id IN (SELECT id FROM m_products)
  EXCEPT SELECT user_id, product_id FROM m_reviews)
SELECT user_id, product_id, (SELECT name FROM m_products WHERE id = product_id) AS name FROM pairs"""

SQL["user_reviews"] = f"""
SELECT id, user_id, {_PRODUCT_NAME} AS name, rating, comment, created_at
FROM m_reviews WHERE product_id IN (SELECT id FROM m_products)"""

# What a user got: an item's buyer is looked up in the delivered orders, others have none.
_DELIVERED = """row(f.user_id, f.product_id) IN (
        SELECT row((SELECT o.user_id FROM m_orders o WHERE o.id = order_id AND o.status = 'delivered'), product_id) FROM m_items)"""

SQL["review_eligibility"] = f"SELECT f.seq, f.user_id, f.product_id FROM f_reviews f WHERE {_DELIVERED}"

_REVIEW_CTES = f"""
WITH sub AS (
  SELECT seq, user_id, product_id, CAST(greatest(1, least(5, rating)) AS INTEGER) AS rating,
         {ptrim('comment')} AS comment,
         {_DELIVERED} AS delivered,
         EXISTS (SELECT 1 FROM m_reviews r WHERE r.user_id = f.user_id AND r.product_id = f.product_id) AS reviewed
  FROM f_reviews f),
acc AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY seq) AS rn
                 FROM sub WHERE delivered AND NOT reviewed) WHERE rn = 1)"""

SQL["review_submissions"] = _REVIEW_CTES + f"""
SELECT id, user_id, product_id, rating, comment, created_at FROM m_reviews
UNION ALL
SELECT (SELECT max(id) FROM m_reviews) + row_number() OVER (ORDER BY seq), user_id, product_id, rating, comment,
       {T0}
FROM acc"""

SQL["review_submissions_after_delivery"] = SQL["review_submissions"].replace(
    "o.status = 'delivered'", f"(o.status = 'delivered' OR o.status IN ('pending', 'completed') AND o.created_at < {T0})")

SQL["review_rejects"] = _REVIEW_CTES + f"""
SELECT seq, user_id, product_id,
       CASE WHEN NOT delivered THEN '{reviews.NOT_DELIVERED}'
            ELSE '{reviews.ALREADY_REVIEWED}' END AS reason
FROM sub WHERE seq NOT IN (SELECT seq FROM acc)"""

# ---------------------------------------------------------------- change jobs
# One request per step and product: the state is (exists, ever existed, owner, current fields).
_PRODUCT_CTES = f"""
WITH RECURSIVE f AS (
  SELECT seq, op, product_id, {ptrim('name')} AS name, {ptrim('description')} AS description,
         {ptrim('image_url')} AS image_url, price, stock, category_id, seller_id AS actor,
         row_number() OVER (PARTITION BY product_id ORDER BY seq) AS rn
  FROM f_products),
chk AS (
  SELECT *, CASE WHEN least(length(name), length(description), length(image_url)) = 0 OR price <= 0 OR stock < 0
                      OR category_id <= 0 THEN '{changes.MSG_FIELDS}'
                 WHEN category_id NOT IN (SELECT id FROM m_categories) THEN '{changes.MSG_NO_CATEGORY}' END AS bad
  FROM f),
st AS (
  SELECT DISTINCT f.product_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op,
         p.id IS NOT NULL AS here, p.id IS NOT NULL AS ever, p.seller_id AS owner, CAST(NULL AS VARCHAR) AS reason,
         CAST(NULL AS BIGINT) AS won, FALSE AS fresh
  FROM f LEFT JOIN m_products p ON p.id = f.product_id
  UNION ALL
  SELECT st.product_id, c.rn, c.seq, c.op,
         CASE c.op WHEN 'add' THEN st.here OR (c.bad IS NULL AND NOT st.ever)
                   WHEN 'delete' THEN st.here AND st.owner <> c.actor ELSE st.here END,
         st.ever OR (c.op = 'add' AND c.bad IS NULL),
         CASE WHEN c.op = 'add' AND c.bad IS NULL AND NOT st.ever THEN c.actor ELSE st.owner END,
         CASE WHEN c.op = 'update' AND NOT (st.here AND st.owner = c.actor) THEN '{changes.MSG_NOT_FOUND}'
              WHEN c.op <> 'delete' AND c.bad IS NOT NULL THEN c.bad
              WHEN c.op = 'add' AND st.ever THEN '{changes.MSG_ID_TAKEN}' END,
         CASE WHEN c.bad IS NULL AND ((c.op = 'add' AND NOT st.ever) OR (c.op = 'update' AND st.here AND st.owner = c.actor))
              THEN c.seq ELSE st.won END,
         st.fresh OR (c.op = 'add' AND c.bad IS NULL AND NOT st.ever)
  FROM st JOIN chk c ON c.product_id = st.product_id AND c.rn = st.rn + 1),
fin AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY rn DESC) = 1)"""

SQL["product_changes"] = _PRODUCT_CTES + f"""
SELECT id, name, description, image_url, price, stock, category_id, seller_id, created_at
FROM m_products WHERE id NOT IN (SELECT product_id FROM fin WHERE NOT here OR won IS NOT NULL)
UNION ALL
SELECT fin.product_id, c.name, c.description, c.image_url, c.price, c.stock, c.category_id, fin.owner,
       CASE WHEN fin.fresh THEN {T0} ELSE (SELECT created_at FROM m_products WHERE id = fin.product_id) END
FROM fin JOIN chk c ON c.seq = fin.won WHERE fin.here"""

SQL["product_change_rejects"] = _PRODUCT_CTES + "\nSELECT seq, op, product_id, reason FROM st WHERE reason IS NOT NULL"

SQL["category_insert_ignore"] = f"""
WITH n AS (SELECT seq, {ptrim('name')} AS name FROM f_categories),
f AS (SELECT min(seq) AS seq, arg_min(name, seq) AS name FROM n WHERE name <> '' GROUP BY strip_accents(lower(name))),
nw AS (SELECT * FROM f WHERE strip_accents(lower(name)) NOT IN (SELECT strip_accents(lower(name)) FROM m_categories))
SELECT id, name FROM m_categories
UNION ALL
SELECT (SELECT max(id) FROM m_categories) + row_number() OVER (ORDER BY seq), name FROM nw"""

SQL["mark_delivered"] = f"""
SELECT id, user_id, delivery_address_id,
       CASE WHEN status IN ('pending', 'completed') AND created_at <= {T0} - INTERVAL 1 MINUTE
            THEN 'delivered' ELSE status END AS status,
       created_at
FROM m_orders"""

SQL["user_changes"] = """
WITH ch AS (
  SELECT seq, user_id,
         CASE WHEN role IN ('admin', 'seller', 'customer') THEN role ELSE 'customer' END AS new_role,
         CASE WHEN account_status IN ('pending', 'active', 'suspended') THEN account_status ELSE 'active' END
           AS new_status
  FROM f_users),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM ch)
      WHERE rn = 1)
SELECT u.id, u.name, u.email, coalesce(l.new_role, u.role) AS role,
       coalesce(l.new_status, u.account_status) AS account_status, u.created_at
FROM m_users u LEFT JOIN l ON l.user_id = u.id"""

SQL["order_status_changes"] = """
WITH ch AS (
  SELECT seq, order_id,
         CASE WHEN status IN ('pending', 'completed', 'delivered', 'cancelled') THEN status ELSE 'pending' END
           AS new_status
  FROM f_order_status WHERE order_id IN (SELECT id FROM m_orders)),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY seq DESC) AS rn FROM ch)
      WHERE rn = 1)
SELECT o.id, o.user_id, o.delivery_address_id, coalesce(l.new_status, o.status) AS status, o.created_at
FROM m_orders o LEFT JOIN l ON l.order_id = o.id"""

_CART_CTES = f"""
WITH RECURSIVE ev AS (
  SELECT f.seq, f.user_id, f.product_id, f.op, greatest(1, coalesce(f.quantity, 0)) AS q, p.stock,
         c.quantity AS init_qty, c.id AS init_id,
         row_number() OVER (PARTITION BY f.user_id, f.product_id ORDER BY f.seq) AS rn
  FROM f_cart f
  LEFT JOIN m_products p ON p.id = f.product_id
  LEFT JOIN m_cart c ON c.user_id = f.user_id AND c.product_id = f.product_id),
st AS (
  SELECT DISTINCT user_id, product_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq,
         CAST(NULL AS VARCHAR) AS op, CAST(coalesce(init_qty, 0) AS INTEGER) AS s, CAST(NULL AS BIGINT) AS created,
         CAST(NULL AS VARCHAR) AS reason, init_id
  FROM ev
  UNION ALL
  SELECT e.user_id, e.product_id, e.rn, e.seq, e.op,
         CAST(CASE WHEN e.op = 'remove' THEN 0
                   WHEN e.op = 'add' THEN CASE WHEN e.stock IS NULL OR st.s + e.q > e.stock THEN st.s
                                               ELSE st.s + e.q END
                   ELSE CASE WHEN st.s = 0 OR e.stock IS NULL OR e.q > e.stock THEN st.s ELSE e.q END
              END AS INTEGER),
         CASE WHEN e.op = 'remove' THEN NULL
              WHEN e.op = 'add' AND e.stock IS NOT NULL AND st.s + e.q <= e.stock AND st.s = 0 THEN e.seq
              ELSE st.created END,
         CASE WHEN e.op = 'add' AND e.stock IS NULL THEN '{changes.MSG_NOT_FOUND}'
              WHEN e.op = 'add' AND st.s + e.q > e.stock THEN '{changes.MSG_STOCK}'
              WHEN e.op = 'set' AND st.s = 0 THEN '{changes.MSG_NO_CART_ITEM}'
              WHEN e.op = 'set' AND (e.stock IS NULL OR e.q > e.stock)
                THEN '{changes.MSG_STOCK}' END,
         st.init_id
  FROM st JOIN ev e ON e.user_id = st.user_id AND e.product_id = st.product_id AND e.rn = st.rn + 1),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY rn DESC) AS r
                       FROM st) WHERE r = 1)"""

SQL["cart_changes"] = _CART_CTES + """
SELECT c.id, c.user_id, c.product_id, c.quantity FROM m_cart c
WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_id = c.user_id AND ev.product_id = c.product_id)
UNION ALL
SELECT init_id, user_id, product_id, s FROM fin WHERE s > 0 AND created IS NULL
UNION ALL
SELECT (SELECT max(id) FROM m_cart) + row_number() OVER (ORDER BY created), user_id, product_id, s
FROM fin WHERE s > 0 AND created IS NOT NULL"""

SQL["cart_change_rejects"] = _CART_CTES + """
SELECT seq, user_id, product_id, op, reason FROM st WHERE reason IS NOT NULL"""

_ADDRESS_CTES = rf"""
WITH f AS (
  SELECT seq, user_id, {ptrim('phone')} AS phone, {ptrim('city')} AS city, {ptrim('address')} AS address
  FROM f_addresses),
r AS (
  SELECT *, CASE WHEN phone = '' OR city = '' OR address = '' THEN '{changes.MSG_ADDRESS}'
                 WHEN NOT (length(regexp_replace(phone, '\D+', '', 'g')) BETWEEN 10 AND 15)
                   THEN '{changes.MSG_PHONE}' END AS reason
  FROM f),
good AS (
  SELECT seq, user_id, regexp_replace(phone, '\s+', ' ', 'g') AS phone, city, address FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM r WHERE reason IS NULL)
  WHERE rn = 1),
g AS (SELECT good.*, da.id AS saved_id FROM good LEFT JOIN v_default_address da ON da.user_id = good.user_id)"""

SQL["address_upsert"] = _ADDRESS_CTES + f"""
SELECT a.id, a.user_id,
       CASE WHEN u.id IS NOT NULL THEN u.phone ELSE a.phone END AS phone,
       CASE WHEN u.id IS NOT NULL THEN u.city ELSE a.city END AS city,
       CASE WHEN u.id IS NOT NULL THEN u.address ELSE a.address END AS address,
       CASE WHEN u.id IS NOT NULL THEN TRUE ELSE a.is_default END AS is_default,
       a.created_at
FROM m_addresses a
LEFT JOIN (SELECT saved_id AS id, phone, city, address FROM g WHERE saved_id IS NOT NULL) u ON u.id = a.id
UNION ALL
SELECT (SELECT max(id) FROM m_addresses) + row_number() OVER (ORDER BY seq), user_id, phone, city, address,
       TRUE, {T0}
FROM g WHERE saved_id IS NULL"""

SQL["address_rejects"] = _ADDRESS_CTES + "\nSELECT seq, user_id, reason FROM r WHERE reason IS NOT NULL"

SQL["rating_summary_upsert"] = """
SELECT product_id,
       CASE WHEN product_id % 3 = 0 OR product_id IN (SELECT product_id FROM m_reviews WHERE created_at >= TIMESTAMP '1997-01-01')
            THEN review_count ELSE review_count + 1000 END AS review_count,
       average_rating
FROM v_rating_summary"""

_TABLES = {"users": "m_users", "user_addresses": "m_addresses", "categories": "m_categories", "products": "m_products",
           "cart": "m_cart", "orders": "m_orders", "order_items": "m_items", "reviews": "m_reviews", "payments": "m_payments",
           "invoices": "m_invoices", "rating_summary": "v_rating_summary"}


def _cascade(victim: str, gone: dict[str, str]) -> str:
    """Rows left per table; ``gone`` holds the condition on a row of each table that the delete reaches (v.id: the victim)."""
    rows = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows_left FROM {src} t"
        + (f" WHERE ({gone[t]}) IS NOT TRUE" if t in gone else "") for t, src in _TABLES.items())
    return f"WITH v AS ({victim})\n{rows}"


def _of_products(which: str) -> dict[str, str]:
    """Conditions on the tables below products, for the products that ``which`` selects."""
    child = f"t.product_id IN (SELECT id FROM m_products WHERE {which})"
    return {"products": f"t.id IN (SELECT id FROM m_products WHERE {which})", **{c: child for c in ("cart", "order_items", "reviews", "rating_summary")}}


_V = "(SELECT id FROM v)"
_OWN_ORDERS = f"(SELECT id FROM m_orders WHERE user_id = {_V})"
_OF_USER = _of_products(f"seller_id = {_V}")
_USER_GONE = {
    **_OF_USER, "users": f"t.id = {_V}", "user_addresses": f"t.user_id = {_V}", "orders": f"t.user_id = {_V}",
    "cart": f"{_OF_USER['cart']} OR t.user_id = {_V}", "reviews": f"{_OF_USER['reviews']} OR t.user_id = {_V}",
    "order_items": f"{_OF_USER['order_items']} OR t.order_id IN {_OWN_ORDERS}",
    "payments": f"t.order_id IN {_OWN_ORDERS}", "invoices": f"t.order_id IN {_OWN_ORDERS}"}
SQL["cascade_delete_category"] = _cascade("SELECT min(category_id) AS id FROM m_products",
                                          {"categories": f"t.id = {_V}", **_of_products(f"category_id = {_V}")})
SQL["cascade_delete_user"] = _cascade("SELECT min(seller_id) AS id FROM m_products", _USER_GONE)
SQL["cascade_delete_customer"] = _cascade("SELECT min(user_id) AS id FROM m_reviews", _USER_GONE)
SQL["cascade_delete_product"] = _cascade("SELECT min(product_id) AS id FROM m_items", _of_products(f"id = {_V}"))
SQL["cascade_delete_order"] = _cascade("SELECT min(order_id) AS id FROM m_invoices", {
    "orders": f"t.id = {_V}", **{c: f"t.order_id = {_V}" for c in ("order_items", "payments", "invoices")}})
SQL["cascade_delete_review"] = _cascade("SELECT min(id) AS id FROM m_reviews", {"reviews": f"t.id = {_V}"})


def _cascade_rows(victims: str, gone: dict[str, str], lost: str = "") -> str:
    """Ids of the rows of each table that the delete reaches, and of the orders that keep their row and lose their address."""
    key = lambda t: "product_id" if t == "rating_summary" else "id"
    parts = [f"SELECT '{t}' AS table_name, t.{key(t)} AS record_id, 'deleted' AS effect, NULL::VARCHAR AS column_name "
             f"FROM {_TABLES[t]} t WHERE {c}" for t, c in gone.items()]
    if lost:
        parts.append(f"SELECT 'orders', t.id, 'set null', 'delivery_address_id' FROM m_orders t WHERE {lost}")
    return f"WITH v AS ({victims})\n" + " UNION ALL ".join(parts)


SQL["cascade_rows_category"] = _cascade_rows("SELECT min(category_id) AS id FROM m_products",
                                             {"categories": f"t.id = {_V}", **_of_products(f"category_id = {_V}")})
SQL["cascade_rows_users"] = _cascade_rows(
    "SELECT id FROM m_users WHERE account_status = 'suspended'",
    {t: c.replace("= (SELECT", "IN (SELECT") for t, c in _USER_GONE.items()},
    f"t.user_id NOT IN {_V} AND t.delivery_address_id IN (SELECT id FROM m_addresses WHERE user_id IN {_V})")
SQL["cascade_rows_addresses"] = _cascade_rows("SELECT id FROM m_addresses WHERE NOT is_default",
                                              {"user_addresses": f"t.id IN {_V}"}, f"t.delivery_address_id IN {_V}")


# ---------------------------------------------------------------- data quality
_STAGED = """rv AS (SELECT id, user_id, product_id, rating FROM m_reviews
       UNION ALL SELECT seq, user_id, product_id, rating FROM f_reviews)"""

SQL["dq_row_checks"] = f"""
WITH {_STAGED}
SELECT 'users' AS table_name, 'email length 5-100' AS rule, id AS record_id FROM m_users
  WHERE NOT (length(email) BETWEEN 5 AND 100)
UNION ALL SELECT 'users', 'role allowed', id FROM m_users WHERE NOT (role IN ('admin', 'seller', 'customer'))
UNION ALL SELECT 'users', 'account_status allowed', id FROM m_users
  WHERE NOT (account_status IN ('pending', 'active', 'suspended'))
UNION ALL SELECT 'users', 'name not null', id FROM m_users WHERE name IS NULL
UNION ALL SELECT 'users', 'email not null', id FROM m_users WHERE email IS NULL
UNION ALL SELECT 'cart', 'quantity > 0', id FROM m_cart WHERE NOT (quantity > 0)
UNION ALL SELECT 'orders', 'status allowed', id FROM m_orders
  WHERE NOT (status IN ('pending', 'completed', 'delivered', 'cancelled'))
UNION ALL SELECT 'order_items', 'quantity > 0', id FROM m_items WHERE NOT (quantity > 0)
UNION ALL SELECT 'order_items', 'price not null', id FROM m_items WHERE price IS NULL
UNION ALL SELECT 'reviews', 'rating 1-5', id FROM rv WHERE NOT (rating BETWEEN 1 AND 5)
UNION ALL SELECT 'payments', 'card_last4 4 chars', id FROM m_payments
  WHERE NOT (card_last4 IS NULL OR length(card_last4) = 4)
UNION ALL SELECT 'payments', 'payment_method allowed', id FROM m_payments WHERE NOT (payment_method IN ('card', 'cash'))
UNION ALL SELECT 'payments', 'payment_status allowed', id FROM m_payments
  WHERE NOT (payment_status IN ('pending', 'paid'))
UNION ALL SELECT 'products', 'name not null', id FROM m_products WHERE name IS NULL
UNION ALL SELECT 'products', 'price not null', id FROM m_products WHERE price IS NULL"""

_LOCAL, _HOST = "split_part(email, '@', 1)", "split_part(email, '@', 2)"
_LABELS = f"string_split({_HOST}, '.')"
_EMAIL_OK = f"""len(string_split(email, '@')) = 2 AND length(email) <= 100 AND length({_LOCAL}) BETWEEN 1 AND 64
            AND NOT list_contains(string_split({_LOCAL}, '.'), '') AND len({_LABELS}) > 1
            AND len(list_filter({_LABELS}, lambda x: length(x) NOT BETWEEN 1 AND 63 OR x LIKE '-%' OR x LIKE '%-'
                                OR translate(lower(x), 'abcdefghijklmnopqrstuvwxyz0123456789-', '') <> '')) = 0
            AND translate(lower({_LOCAL}), 'abcdefghijklmnopqrstuvwxyz0123456789.!#$%&''*+/=?^_`{{|}}~-', '') = ''"""
_CARD = "regexp_replace(card_number, '\\D+', '', 'g')"

SQL["dq_contacts"] = f"""
SELECT user_id,
       coalesce({_EMAIL_OK}, false) AS email_ok,
       coalesce(length(regexp_replace(phone, '\\D+', '', 'g')) BETWEEN 10 AND 15, false) AS phone_ok,
       coalesce(length({_CARD}) BETWEEN 13 AND 19 AND
                list_sum(list_transform(string_split(reverse({_CARD}), ''), lambda x, i:
                    CASE WHEN i % 2 = 0
                         THEN CASE WHEN 2 * TRY_CAST(x AS INTEGER) > 9 THEN 2 * TRY_CAST(x AS INTEGER) - 9
                                   ELSE 2 * TRY_CAST(x AS INTEGER) END
                         ELSE TRY_CAST(x AS INTEGER) END)) % 10 = 0, false) AS card_ok
FROM f_contacts"""


def _dup(table, cols, expr, src):
    return (f"SELECT '{table}' AS table_name, '{cols}' AS key_columns, {expr} AS key_value, "
            f"count(*) AS occurrences FROM {src} GROUP BY {expr} HAVING count(*) > 1")


def _pair(a, b):
    return f"concat_ws('|', CAST({a} AS VARCHAR), CAST({b} AS VARCHAR))"


SQL["dq_unique"] = f"WITH {_STAGED}\n" + "\nUNION ALL ".join([
    _dup("users", "lower(email)", "lower(email)", "m_users"),
    _dup("categories", "lower(name)", "lower(name)", "m_categories"),
    _dup("cart", "user_id,product_id", _pair("user_id", "product_id"), "m_cart"),
    _dup("order_items", "order_id,product_id", _pair("order_id", "product_id"), "m_items"),
    _dup("reviews", "user_id,product_id", _pair("user_id", "product_id"), "rv"),
    _dup("reviews", "id", "CAST(id AS VARCHAR)", "rv"),
    _dup("payments", "order_id", "CAST(order_id AS VARCHAR)", "m_payments"),
    _dup("invoices", "order_id", "CAST(order_id AS VARCHAR)", "m_invoices"),
    _dup("invoices", "invoice_number", "invoice_number", "m_invoices"),
])


def _fk(child, src, col, parent):
    return (f"SELECT '{child}' AS table_name, '{col}' AS column_name, id AS record_id, {col} AS missing_key "
            f"FROM {src} WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT id FROM {parent})")


SQL["dq_references"] = "WITH np AS (" + SQL["product_changes"].strip() + ")\n" + "\nUNION ALL ".join([
    _fk("user_addresses", "m_addresses", "user_id", "m_users"),
    _fk("products", "np", "category_id", "m_categories"),
    _fk("products", "np", "seller_id", "m_users"),
    _fk("cart", "m_cart", "user_id", "m_users"),
    _fk("cart", "m_cart", "product_id", "np"),
    _fk("orders", "m_orders", "user_id", "m_users"),
    _fk("orders", "m_orders", "delivery_address_id", "m_addresses"),
    _fk("order_items", "m_items", "order_id", "m_orders"),
    _fk("order_items", "m_items", "product_id", "np"),
    _fk("reviews", "m_reviews", "user_id", "m_users"),
    _fk("reviews", "m_reviews", "product_id", "np"),
    _fk("payments", "m_payments", "order_id", "m_orders"),
    _fk("invoices", "m_invoices", "order_id", "m_orders"),
])

# ---------------------------------------------------------------- checkout (sequential, one cart per step)
_OK = ("list_aggregate(list_transform(cl.pids, lambda p, i: "
       "coalesce(map_extract_value(st.used, p), 0) + cl.qtys[i] <= cl.stocks[i]), 'bool_and')")
_CHECKOUT_CTES = f"""
WITH RECURSIVE req AS (SELECT * FROM f_checkout),
ln AS (SELECT r.seq, c.product_id, c.quantity, p.price, p.stock
       FROM req r JOIN m_cart c ON c.user_id = r.user_id JOIN m_products p ON p.id = c.product_id),
q AS (SELECT seq, CAST(sum(quantity * price) AS {M}) AS subtotal FROM ln GROUP BY seq),
cand AS (SELECT seq, row_number() OVER (ORDER BY seq) AS rn FROM q WHERE subtotal > 0),
cl AS (SELECT c.rn, any_value(r.user_id) AS uid, list(ln.product_id ORDER BY ln.product_id) AS pids,
              list(CAST(ln.quantity AS BIGINT) ORDER BY ln.product_id) AS qtys,
              list(CAST(ln.stock AS BIGINT) ORDER BY ln.product_id) AS stocks
       FROM cand c JOIN ln ON ln.seq = c.seq JOIN req r ON r.seq = c.seq GROUP BY c.rn),
st AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(MAP() AS MAP(BIGINT, BIGINT)) AS used, CAST([] AS BIGINT[]) AS served,
         CAST(NULL AS BOOLEAN) AS ok, CAST(NULL AS BOOLEAN) AS emptied
  UNION ALL
  SELECT st.rn + 1,
         CASE WHEN NOT list_contains(st.served, cl.uid) AND {_OK}
              THEN map_concat(st.used, map_from_entries(list_transform(cl.pids, lambda p, i:
                     {{'k': p, 'v': coalesce(map_extract_value(st.used, p), 0) + cl.qtys[i]}})))
              ELSE st.used END,
         CASE WHEN NOT list_contains(st.served, cl.uid) AND {_OK} THEN list_append(st.served, cl.uid) ELSE st.served END,
         NOT list_contains(st.served, cl.uid) AND {_OK},
         list_contains(st.served, cl.uid)
  FROM st JOIN cl ON cl.rn = st.rn + 1),
dec AS (SELECT c.seq, st.ok, st.emptied FROM st JOIN cand c ON c.rn = st.rn),
acc AS (SELECT seq, (SELECT max(id) FROM m_orders) + row_number() OVER (ORDER BY seq) AS order_id
        FROM dec WHERE ok)"""

SQL["checkout_decisions"] = _CHECKOUT_CTES + f"""
SELECT r.seq, r.user_id,
       CASE WHEN acc.seq IS NOT NULL THEN 'accepted' ELSE 'rejected' END AS decision,
       CASE WHEN coalesce(q.subtotal, 0) <= 0 OR d.emptied THEN '{checkout.MSG_EMPTY}'
            WHEN acc.seq IS NULL THEN '{checkout.MSG_STOCK}' END AS reason,
       CAST(CASE WHEN d.emptied THEN 0 ELSE coalesce(q.subtotal, 0) END AS {M}) AS subtotal,
       CASE WHEN acc.seq IS NOT NULL THEN CAST(round(q.subtotal * 0.05, 2) AS {M}) END AS tax_amount,
       CASE WHEN acc.seq IS NOT NULL THEN CAST(q.subtotal + 10.00 + round(q.subtotal * 0.05, 2) AS {M}) END
         AS total_amount,
       acc.order_id
FROM req r LEFT JOIN q ON q.seq = r.seq LEFT JOIN acc ON acc.seq = r.seq LEFT JOIN dec d ON d.seq = r.seq"""

SQL["checkout_stock"] = _CHECKOUT_CTES + """
SELECT p.id, CAST(p.stock - coalesce(u.used, 0) AS INTEGER) AS stock
FROM m_products p
LEFT JOIN (SELECT ln.product_id, sum(ln.quantity) AS used FROM ln JOIN acc ON acc.seq = ln.seq GROUP BY 1) u
  ON u.product_id = p.id"""

SQL["checkout_orders"] = _CHECKOUT_CTES + f"""
SELECT acc.order_id AS id, r.user_id, r.address_id AS delivery_address_id, 'pending' AS status,
       {T0} AS created_at, q.subtotal,
       CAST(round(q.subtotal * 0.05, 2) AS {M}) AS tax_amount,
       CAST(q.subtotal + 10.00 + round(q.subtotal * 0.05, 2) AS {M}) AS total_amount,
       r.payment_method, CASE WHEN r.payment_method = 'card' THEN r.card_last4 END AS card_last4,
       CASE WHEN r.payment_method = 'card' THEN 'paid' ELSE 'pending' END AS payment_status,
       'INV-' || lpad(CAST(acc.order_id AS VARCHAR), CAST(greatest(4, length(CAST(acc.order_id AS VARCHAR)))
                      AS INTEGER), '0') AS invoice_number
FROM acc JOIN req r ON r.seq = acc.seq JOIN q ON q.seq = acc.seq"""



# ---------------------------------------------------------------- audit and streams
SQL["audit_log"] = "WITH np AS (" + SQL["product_changes"].strip() + f"""),
st AS (
  SELECT f.seq, f.order_id,
         CASE WHEN f.status IN ('pending', 'completed', 'delivered', 'cancelled') THEN f.status ELSE 'pending' END
           AS new_status,
         o.status AS base_status
  FROM f_order_status f JOIN m_orders o ON o.id = f.order_id),
ch AS (SELECT order_id, coalesce(lag(new_status) OVER (PARTITION BY order_id ORDER BY seq), base_status)
              AS old_status, new_status FROM st)
SELECT 'reviews' AS table_name, 'INSERT' AS action_type, review_id AS record_id,
       'Product ' || CAST(product_id AS VARCHAR) || ' rated ' || CAST(rating AS VARCHAR) || '/5' AS details,
       changed_at AS created_at
FROM f_review_changes WHERE op = 'INSERT'
UNION ALL
SELECT 'reviews', 'DELETE', review_id, 'Deleted review for product ' || CAST(product_id AS VARCHAR), changed_at
FROM f_review_changes WHERE op = 'DELETE'
UNION ALL
SELECT 'products', 'INSERT', id, 'Product added: ' || name, created_at
FROM np WHERE id NOT IN (SELECT id FROM m_products)
UNION ALL
SELECT 'orders', 'STATUS_CHANGE', order_id, old_status || ' -> ' || new_status, {T0}
FROM ch WHERE old_status <> new_status"""

SQL["order_status_audit"] = """
SELECT 'orders' AS table_name, 'STATUS_CHANGE' AS action_type, order_id AS record_id,
       old_status || ' -> ' || new_status AS details, event_time AS created_at
FROM (SELECT order_id, lag(status) OVER (PARTITION BY order_id ORDER BY event_time) AS old_status,
             status AS new_status, event_time FROM f_order_events)
WHERE old_status <> new_status"""

SQL["stream_rating_summary"] = """
SELECT p.id AS product_id, CAST(coalesce(s.n, 0) AS BIGINT) AS review_count,
       CAST(CASE WHEN coalesce(s.n, 0) > 0 THEN ((200 * CAST(s.rs AS HUGEINT) + s.n) // (2 * s.n)) / 100
                 ELSE 0 END AS DECIMAL(3,2)) AS average_rating
FROM m_products p
LEFT JOIN (SELECT product_id, sum(sign) AS n, sum(sign * rating) AS rs FROM f_review_changes GROUP BY product_id) s
  ON s.product_id = p.id"""

SQL["stream_mark_delivered"] = """
WITH due AS (SELECT order_id, created_at + INTERVAL 1 MINUTE AS delivered_at, arg_max(status, event_time) AS previous_status
             FROM f_order_events WHERE event_time - created_at <= INTERVAL 1 MINUTE GROUP BY order_id, created_at)
SELECT * FROM due
WHERE previous_status <> 'cancelled' AND delivered_at <= (SELECT max(event_time) FROM f_order_events)"""

SQL["stream_cart_guard"] = f"""
SELECT seq, user_id, product_id, quantity, reason, reason IS NULL AS accepted FROM (
  SELECT f.seq, f.user_id, f.product_id, f.quantity,
         CASE WHEN f.quantity <= 0 THEN '{streams.MSG_POSITIVE}'
              WHEN p.stock IS NULL OR f.quantity > p.stock THEN '{streams.MSG_EXCEEDS}' END AS reason
  FROM f_cart f LEFT JOIN m_products p ON p.id = f.product_id
  WHERE f.op IN ('add', 'set'))"""

SQL["stream_cart_guard_as_of"] = f"""
WITH told AS (
  SELECT id AS product_id, CAST(-1 AS BIGINT) AS seq, stock FROM m_products
  UNION ALL SELECT product_id, seq, CAST(seq % 60 AS INTEGER) FROM f_cart WHERE op = 'remove'),
ruled AS (
  SELECT f.seq, f.user_id, f.product_id, f.quantity,
         CASE WHEN f.quantity <= 0 THEN '{streams.MSG_POSITIVE}'
              WHEN NOT coalesce(f.quantity <= s.stock, s.product_id IS NOT NULL AND s.stock IS NOT NULL) THEN '{streams.MSG_EXCEEDS}' END AS reason
  FROM f_cart f ASOF LEFT JOIN told s ON s.product_id = f.product_id AND s.seq <= f.seq
  WHERE f.op <> 'remove')
SELECT *, reason IS NULL AS accepted FROM ruled"""

SQL["stream_daily_sales"] = SQL["daily_sales"]
SQL["stream_order_status_audit"] = SQL["order_status_audit"]
SQL["stream_review_audit"] = """
SELECT 'reviews' AS table_name, op AS action_type, review_id AS record_id,
       CASE WHEN op = 'INSERT'
            THEN 'Product ' || CAST(product_id AS VARCHAR) || ' rated ' || CAST(rating AS VARCHAR) || '/5'
            ELSE 'Deleted review for product ' || CAST(product_id AS VARCHAR) END AS details,
       changed_at AS created_at
FROM f_review_changes"""

SQL["stream_audit_table"] = f"""
WITH np AS ({SQL["product_changes"].strip()}),
told AS (
  SELECT 'reviews' AS table_name, op AS action_type, review_id AS record_id,
         CASE op WHEN 'DELETE' THEN concat('Deleted review for product ', product_id) ELSE format('Product {{}} rated {{}}/5', product_id, rating) END AS details,
         changed_at AS created_at
  FROM f_review_changes
  UNION ALL SELECT 'products', 'INSERT', id, concat('Product added: ', name), created_at FROM np ANTI JOIN m_products USING (id)
  UNION ALL SELECT * FROM ({SQL["order_status_audit"].strip()}))
SELECT * FROM told"""


def oracle_sql() -> dict[str, str]:
    return {k: with_ctes(v) for k, v in SQL.items()}
