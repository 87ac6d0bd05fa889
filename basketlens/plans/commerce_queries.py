"""Inventory, catalogue and cart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cart as ct
from ..operators import catalog as cg
from ..operators import inventory as inv
from ..operators.sequences import number_within
from ..sources.shared import shared_path
from .registry import query

REPLAY_VIEWS = {
    "replayed": (("ledger", "opening_stock"), """
        SELECT * FROM (
          WITH RECURSIVE l AS (SELECT ledger.sku, seq, op, qty, ts, o.opening
                               FROM ledger JOIN opening_stock o USING (sku)),
          r AS (
            SELECT sku, seq, op, qty, ts, acc AS accepted, opening AS available_before,
                   opening + CASE WHEN acc = 1 THEN CASE op WHEN 'DEDUCT' THEN -qty WHEN 'RESERVE' THEN -qty
                                                          WHEN 'ADD' THEN qty ELSE 0 END ELSE 0 END AS available_after,
                   opening + CASE WHEN acc = 1 THEN CASE op WHEN 'DEDUCT' THEN -qty WHEN 'ADD' THEN qty ELSE 0 END
                                  ELSE 0 END AS total_after,
                   CAST(CASE WHEN acc = 1 AND op = 'RESERVE' THEN qty ELSE 0 END AS BIGINT) AS reserved_after
            FROM (SELECT *, CASE WHEN op IN ('DEDUCT', 'RESERVE') AND opening >= qty THEN 1
                                 WHEN op = 'ADD' THEN 1 ELSE 0 END AS acc FROM l WHERE seq = 1)
            UNION ALL
            SELECT sku, seq, op, qty, ts, acc, prev_avail,
                   prev_avail + CASE WHEN acc = 1 THEN CASE op WHEN 'DEDUCT' THEN -qty WHEN 'RESERVE' THEN -qty
                        WHEN 'ROLLBACK' THEN prev_qty ELSE qty END ELSE 0 END,
                   prev_total + CASE WHEN acc = 1 THEN CASE op WHEN 'DEDUCT' THEN -qty WHEN 'ROLLBACK' THEN prev_qty
                        WHEN 'ADD' THEN qty ELSE 0 END ELSE 0 END,
                   prev_res + CASE WHEN acc = 1 THEN CASE op WHEN 'RESERVE' THEN qty WHEN 'CANCEL' THEN -qty
                        ELSE 0 END ELSE 0 END
            FROM (SELECT l.sku, l.seq, l.op, l.qty, l.ts, r.available_after AS prev_avail,
                         r.total_after AS prev_total, r.reserved_after AS prev_res, r.qty AS prev_qty,
                         CASE l.op WHEN 'DEDUCT' THEN CAST(r.available_after >= l.qty AS INTEGER)
                                   WHEN 'RESERVE' THEN CAST(r.available_after >= l.qty AS INTEGER)
                                   WHEN 'ROLLBACK' THEN CAST(r.op = 'DEDUCT' AND r.accepted = 1 AS INTEGER)
                                   WHEN 'CANCEL' THEN CAST(r.reserved_after >= l.qty AS INTEGER) ELSE 1 END AS acc
                  FROM r JOIN l ON l.sku = r.sku AND l.seq = r.seq + 1))
          SELECT * FROM r)""", True),
}
REPLAY_SQL_BAL = """
SELECT sku, arg_max(available_after, seq) AS available, arg_max(total_after, seq) AS total,
       arg_max(reserved_after, seq) AS reserved, count(*) AS ops, CAST(sum(accepted) AS BIGINT) AS accepted_ops
FROM replayed GROUP BY sku"""


def _replayed(fx):
    return inv.replay(fx.ledger_ops, fx.opening_stock, order=fx.ledger_order)


@query("inventory_replay", views=("replayed",), extra_views=REPLAY_VIEWS, oracle="SELECT * FROM replayed")
def inventory_replay(fx):
    """Stock ledger replay (accept/reject, before/after per op)."""
    return _replayed(fx)


# Every rollback accepted with its own quantity.
RELAXED_VIEWS = {"replayed": (REPLAY_VIEWS["replayed"][0], REPLAY_VIEWS["replayed"][1]
                              .replace("WHEN op = 'ADD' THEN 1", "WHEN op IN ('ADD', 'ROLLBACK') THEN 1")
                              .replace("WHEN 'ADD' THEN qty ELSE 0", "WHEN 'ADD' THEN qty WHEN 'ROLLBACK' THEN qty ELSE 0")
                              .replace("THEN prev_qty", "THEN qty")
                              .replace("CAST(r.op = 'DEDUCT' AND r.accepted = 1 AS INTEGER)", "1"), True)}


@query("inventory_replay_relaxed", views=("replayed",), extra_views=RELAXED_VIEWS, oracle="SELECT * FROM replayed")
def inventory_replay_relaxed(fx):
    """X2 without the rollback guard (strict=False)."""
    return inv.replay(fx.ledger_ops, fx.opening_stock, strict=False, order=fx.ledger_order)


@query("inventory_balance", views=("replayed",), extra_views=REPLAY_VIEWS, oracle=REPLAY_SQL_BAL)
def inventory_balance(fx):
    """Final stock state per sku."""
    return inv.balances(_replayed(fx))


@query("inventory_change_log", views=("replayed",), extra_views=REPLAY_VIEWS, oracle="""
SELECT sku, seq, ts, CASE WHEN available_after < available_before THEN 'DEDUCT' ELSE 'ADD' END AS change_type,
       abs(available_after - available_before) AS quantity, available_before AS before, available_after AS after
FROM replayed WHERE available_after <> available_before""")
def inventory_change_log(fx):
    """P15/ST11 batch twin: change log of available stock."""
    return inv.change_log(_replayed(fx))


@query("low_stock", views=("replayed",), extra_views=REPLAY_VIEWS, oracle=f"""
SELECT sku, available AS current, 20 AS threshold, CASE WHEN available <= 0 THEN 'OUT' ELSE 'LOW' END AS alert_type
FROM ({REPLAY_SQL_BAL}) WHERE available <= 20""")
def low_stock(fx):
    """Low / out-of-stock alerts after the replay."""
    return inv.low_stock(inv.balances(_replayed(fx)))


@query("inventory_snapshot", views=("replayed",), extra_views=REPLAY_VIEWS, oracle="""
SELECT sku, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS snapshot_day, arg_max(available_after, seq) AS available,
       arg_max(total_after, seq) AS total, arg_max(reserved_after, seq) AS reserved
FROM replayed GROUP BY sku, CAST(ts AS DATE)""")
def inventory_snapshot(fx):
    """End-of-day stock per sku."""
    return inv.daily_snapshot(_replayed(fx))


@query("orphan_rollbacks", views=("ledger",), oracle="""
SELECT sku, seq - 1 AS orig_seq, seq
FROM (SELECT *, lag(op) OVER (PARTITION BY sku ORDER BY seq) AS prev_op FROM ledger)
WHERE op = 'ROLLBACK' AND prev_op IS DISTINCT FROM 'DEDUCT'""")
def orphan_rollbacks(fx):
    """Rollbacks without an original DEDUCT."""
    return inv.orphan_rollbacks(fx.ledger_ops, fx.ledger_order)


@query("expired_reservations", views=("ledger",), oracle="""
SELECT r.sku, r.seq, r.ts AS reserved_at, r.ts + INTERVAL 1 HOUR AS expires_at FROM ledger r
WHERE r.op = 'RESERVE' AND NOT EXISTS (
  SELECT 1 FROM ledger d WHERE d.sku = r.sku AND d.op = 'DEDUCT' AND d.ts > r.ts AND d.ts <= r.ts + INTERVAL 1 HOUR)""")
def expired_reservations(fx):
    """ST8 batch twin: reservations not followed by a DEDUCT within 1 hour."""
    return inv.expired_reservations(fx.ledger)


@query("expired_reservations_1d", views=("ledger",), oracle="""
SELECT r.sku, r.seq, r.ts AS reserved_at, r.ts + INTERVAL 1 DAY AS expires_at FROM ledger r
WHERE r.op = 'RESERVE' AND NOT EXISTS (
  SELECT 1 FROM ledger d WHERE d.sku = r.sku AND d.op = 'DEDUCT' AND d.ts > r.ts AND d.ts <= r.ts + INTERVAL 1 DAY)""")
def expired_reservations_1d(fx):
    """ST8 with a day's hold (the fixture's ops are days apart)."""
    return inv.expired_reservations(fx.ledger, 86400)


@query("price_change", views=("ledger",), oracle="""
WITH j AS (SELECT sku, seq, ts, old_cents, unit_price_cents AS new_cents
           FROM (SELECT *, lag(unit_price_cents) OVER (PARTITION BY sku ORDER BY seq) AS old_cents FROM ledger) WHERE seq > 1),
k AS (SELECT *, new_cents - old_cents AS diff,
             CASE WHEN old_cents = 0 THEN NULL
                  ELSE CAST(sign((new_cents - old_cents) * 10000) * sign(old_cents)
                       * floor((abs((new_cents - old_cents) * 10000) * 2 + abs(old_cents)) / (abs(old_cents) * 2))
                       AS BIGINT)
             END AS q4 FROM j)
SELECT sku, seq, ts, old_cents / 100.0e0 AS old_price, new_cents / 100.0e0 AS new_price, diff / 100.0e0 AS change_amount,
       CASE WHEN old_cents = 0 THEN 'N/A' ELSE
         (CASE WHEN q4 < 0 THEN '-' ELSE '' END) || CAST(CAST(abs(q4) // 100 AS BIGINT) AS VARCHAR)
         || (CASE WHEN abs(q4) % 100 = 0 THEN ''
                  WHEN abs(q4) % 10 = 0 THEN '.' || CAST(CAST(abs(q4) % 100 // 10 AS BIGINT) AS VARCHAR)
                  ELSE '.' || lpad(CAST(CAST(abs(q4) % 100 AS BIGINT) AS VARCHAR), 2, '0') END) || '%' END
         AS change_percentage
FROM k""")
def price_change(fx):
    """Price history with change amount and percentage text."""
    return inv.price_changes(fx.ledger_ops, fx.ledger_order)


# -- catalogue ---------------------------------------------------------------
PRODUCTS_SQL = """
SELECT p_partkey AS product_id, p_name AS name, p_brand AS description, p_retailprice AS price,
       p_size - 5 AS stock, CASE WHEN p_type = 'PROMO' THEN 'OFF_SHELF' ELSE 'AVAILABLE' END AS status,
       p_type AS category_id, p_size FROM part"""


def _products(fx):
    return cg.products(fx.part)


@query("available_products", oracle=f"""
SELECT product_id, name, price, stock, rank, rank // 20 AS page FROM (
  SELECT *, row_number() OVER (ORDER BY price DESC, product_id) - 1 AS rank
  FROM ({PRODUCTS_SQL}) WHERE stock > 0 AND status = 'AVAILABLE')""")
def available_products(fx):
    """Available products with page rank (price desc, id)."""
    p = cg.available_products(_products(fx))
    r = cg.page_rank(p, [-F.col("price"), F.col("product_id")])
    return r.select("product_id", "name", "price", "stock", "rank", "page")


@query("price_range_search", oracle=f"""
SELECT product_id, name, price, category_id FROM ({PRODUCTS_SQL})
WHERE category_id = 'STANDARD' AND price BETWEEN 950 AND 975""")
def price_range_search(fx):
    """Category term + price range."""
    return cg.price_range(_products(fx), "STANDARD", 950, 975).select("product_id", "name", "price",
                                                                        "category_id")


@query("product_search", oracle=f"""
SELECT product_id, name, description FROM ({PRODUCTS_SQL})
WHERE list_has_any(list_filter(string_split_regex(lower(name), '[^a-z0-9]+')
                               || string_split_regex(lower(description), '[^a-z0-9]+'), lambda t: length(t) > 0),
                   ['red', 'bolt'])""")
def product_search(fx):
    """Keyword search over name or description."""
    return cg.keyword_search(_products(fx), ["red", "bolt"]).select("product_id", "name", "description")


@query("product_search_boosted", oracle=f"""
WITH t AS (SELECT product_id, name, description,
                  list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: length(x) > 0) AS tn,
                  list_filter(string_split_regex(lower(description), '[^a-z0-9]+'), lambda x: length(x) > 0) AS td,
                  list_filter(string_split_regex(lower(category_id), '[^a-z0-9]+')
                              || string_split_regex(lower(CAST(p_size AS VARCHAR)), '[^a-z0-9]+'),
                              lambda x: length(x) > 0) AS ts_
           FROM ({PRODUCTS_SQL}))
SELECT product_id, name, description, score FROM (
  SELECT *, CAST(3 * len(list_filter(tn, lambda x: x IN ('small', 'ring', 'economy')))
                 + len(list_filter(td, lambda x: x IN ('small', 'ring', 'economy')))
                 + len(list_filter(ts_, lambda x: x IN ('small', 'ring', 'economy'))) AS BIGINT) AS score FROM t)
WHERE score > 0""")
def product_search_boosted(fx):
    """Boosted multi-field match (name^3, description, specs)."""
    return cg.boosted_search(_products(fx), ["small", "ring", "economy"]).select(
        "product_id", "name", "description", "score")


@query("product_index_search", oracle=f"""
WITH t AS (SELECT product_id, string_split_regex(lower(name), '[^a-z0-9]+') AS tn, string_split_regex(lower(description), '[^a-z0-9]+') AS td,
                  string_split_regex(lower(category_id), '[^a-z0-9]+') || string_split_regex(lower(CAST(p_size AS VARCHAR)), '[^a-z0-9]+') AS ts_
           FROM ({PRODUCTS_SQL})),
s AS (SELECT product_id, CAST(3 * len(list_filter(tn, lambda x: x IN ('small', 'ring', 'economy'))) + len(list_filter(td, lambda x: x IN ('small', 'ring', 'economy')))
                              + len(list_filter(ts_, lambda x: x IN ('small', 'ring', 'economy'))) AS BIGINT) AS score FROM t)
SELECT * FROM s WHERE score > 0""")
def product_index_search(fx):
    """The boosted match from an inverted index: written once, then only the terms' lists are read."""
    path = shared_path(fx.spark, "product-index")
    cg.write_index(_products(fx), path)
    return cg.search_index(fx.spark, path, ["small", "ring", "economy"])


@query("order_status_audit", oracle="""
WITH e AS (
  SELECT o_orderkey AS order_id, CAST(o_orderdate AS TIMESTAMP) AS ts, 'CREATED' AS status, 0 AS line FROM orders
  UNION ALL
  SELECT l_orderkey, CAST(l_shipdate AS TIMESTAMP), CASE l_returnflag WHEN 'A' THEN 'PAID' WHEN 'N' THEN 'SHIPPED' ELSE 'COMPLETED' END, l_linenumber FROM lineitem),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY order_id ORDER BY line, ts, status) AS BIGINT) AS seq FROM e),
p AS (SELECT *, lag(status) OVER (PARTITION BY order_id ORDER BY seq) AS prev_status FROM s)
SELECT order_id, seq, status, ts, prev_status,
       coalesce((prev_status IS NULL AND status = 'CREATED') OR (prev_status, status) IN (('CREATED', 'PAID'), ('PAID', 'SHIPPED'), ('SHIPPED', 'COMPLETED'), ('CREATED', 'CANCELLED')), false) AS valid
FROM p""")
def order_status_audit(fx):
    """Status changes of orders (an order, then its lines by number) against the allowed transitions."""
    made = fx.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.lit("CREATED").alias("status"), F.lit(0).cast("long").alias("line"))
    flag = F.when(F.col("l_returnflag") == "A", "PAID").when(F.col("l_returnflag") == "N", "SHIPPED").otherwise("COMPLETED")
    lines = fx.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), flag.alias("status"), F.col("l_linenumber").cast("long").alias("line"))
    log = number_within(made.unionByName(lines), "order_id", F.floor(F.col("line") / 1000), [F.col("line"), F.col("ts"), F.col("status")])
    return cg.order_status_audit(log)


@query("products_by_category", oracle=f"""
SELECT category_id, product_id, price,
       row_number() OVER (PARTITION BY category_id ORDER BY price DESC, product_id) - 1 AS rank,
       (row_number() OVER (PARTITION BY category_id ORDER BY price DESC, product_id) - 1) // 20 AS page
FROM ({PRODUCTS_SQL})""")
def products_by_category(fx):
    """Products by category with in-category page rank."""
    r = cg.page_rank(_products(fx), [-F.col("price"), F.col("product_id")], partition="category_id")
    return r.select("category_id", "product_id", "price", "rank", "page")


@query("validate_products", oracle="""
WITH r AS (SELECT c_custkey AS request_id, c_name AS name, c_mktsegment AS description, c_acctbal AS price,
                  CAST(floor(c_acctbal) AS BIGINT) AS stock, c_mktsegment AS category_id FROM customer),
f AS (SELECT request_id, list_filter([
        CASE WHEN coalesce(length(trim(name)) = 0, true) THEN 'name_blank' END,
        CASE WHEN coalesce(length(name) > 100, false) THEN 'name_too_long' END,
        CASE WHEN coalesce(length(description) > 1000, false) THEN 'description_too_long' END,
        CASE WHEN price IS NULL THEN 'price_missing' END,
        CASE WHEN coalesce(price < 0.01, false) THEN 'price_below_min' END,
        CASE WHEN coalesce(length(CAST(CAST(floor(abs(price)) AS BIGINT) AS VARCHAR)) > 10
                           OR round(price * 100) <> price * 100, false) THEN 'price_digits' END,
        CASE WHEN coalesce(stock < 0, false) THEN 'stock_negative' END,
        CASE WHEN category_id IS NULL THEN 'category_missing' END], lambda x: x IS NOT NULL) AS l FROM r)
SELECT request_id, array_to_string(l, ',') AS reasons, len(l) = 0 AS valid FROM f""")
def validate_products(fx):
    """P10: product request validation with every failed rule listed."""
    c = fx.customer
    req = c.select(F.col("c_custkey").alias("request_id"), F.col("c_name").alias("name"),
                   F.col("c_mktsegment").alias("description"), F.col("c_acctbal").alias("price"),
                   F.floor("c_acctbal").cast("bigint").alias("stock"), F.col("c_mktsegment").alias("category_id"))
    return cg.validate_products(req).select("request_id", "reasons", "valid")


@query("validate_users", oracle="""
SELECT c_custkey AS user_id,
       array_to_string(list_filter([
         CASE WHEN NOT coalesce(length(c_name) BETWEEN 3 AND 50, false) THEN 'username_length' END,
         CASE WHEN NOT coalesce(regexp_matches(lower(replace(c_name, '#', '.')) || '@shop.example',
                                               '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'), false) THEN 'email_invalid' END],
         lambda x: x IS NOT NULL), ',') AS reasons,
       coalesce(length(c_name) BETWEEN 3 AND 50, false) AND
       coalesce(regexp_matches(lower(replace(c_name, '#', '.')) || '@shop.example', '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'),
                false) AS valid
FROM customer""")
def validate_users(fx):
    """Username length and e-mail shape checks."""
    u = fx.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"),
                           F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@shop.example"))
                           .alias("email"))
    return cg.validate_users(u).select("user_id", "reasons", "valid")


@query("category_tree", oracle="""
WITH RECURSIVE cats AS (
  SELECT CAST(r_regionkey AS BIGINT) AS category_id, r_name AS name, CAST(NULL AS BIGINT) AS parent_id FROM region
  UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), n_name, CAST(n_regionkey AS BIGINT) FROM nation),
tree AS (
  SELECT category_id, name, parent_id, 1 AS level, name AS path FROM cats WHERE parent_id IS NULL
  UNION ALL
  SELECT c.category_id, c.name, c.parent_id, t.level + 1, concat(t.path, ' > ', c.name)
  FROM cats c JOIN tree t ON c.parent_id = t.category_id)
SELECT * FROM tree""")
def category_tree(fx):
    """Category levels and paths of any depth by pointer doubling."""
    return cg.category_tree(cg.categories(fx.region, fx.nation))


@query("category_ancestry", oracle="""
WITH RECURSIVE cats AS (
  SELECT CAST(r_regionkey AS BIGINT) AS category_id, r_name AS name, CAST(NULL AS BIGINT) AS parent_id FROM region
  UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), n_name, CAST(n_regionkey AS BIGINT) FROM nation),
tree AS (
  SELECT category_id, 1 AS level, name AS path, category_id AS root, parent_id FROM cats
  WHERE parent_id IS NULL OR parent_id NOT IN (SELECT category_id FROM cats)
  UNION ALL
  SELECT c.category_id, t.level + 1, concat(t.path, ' > ', c.name), t.root, t.parent_id FROM cats c JOIN tree t ON c.parent_id = t.category_id)
SELECT c.category_id, c.name, c.parent_id, CASE WHEN t.parent_id IS NULL THEN t.level END AS level, CASE WHEN t.parent_id IS NULL THEN t.path END AS path,
       CASE WHEN t.root IS NULL THEN 'loop' WHEN t.parent_id IS NOT NULL THEN 'orphan' ELSE 'ok' END AS status
FROM cats c LEFT JOIN tree t ON t.category_id = c.category_id""")
def category_ancestry(fx):
    """Every category with its level, path and status (ok, orphan, loop)."""
    return cg.category_ancestry(cg.categories(fx.region, fx.nation))


@query("category_product_counts", oracle="""
SELECT p_type AS category_id, count(*) AS products FROM part GROUP BY p_type""")
def category_product_counts(fx):
    """Products per category."""
    return cg.count_per_category(_products(fx))


@query("product_view", oracle=f"""
SELECT p.product_id, p.name, p.price, p.category_id, c.products AS category_products,
       lower(p.category_id) AS spec_type, CAST(p.p_size AS VARCHAR) AS spec_size
FROM ({PRODUCTS_SQL}) p JOIN (SELECT p_type, count(*) AS products FROM part GROUP BY p_type) c
  ON c.p_type = p.category_id""")
def product_view(fx):
    """Product response joined with its category's product count and
    spec attributes looked up from the product's map."""
    p = _products(fx)
    return p.join(cg.count_per_category(p).withColumnRenamed("products", "category_products"),
                  "category_id").select("product_id", "name", "price", "category_id", "category_products",
                                        F.lower(F.element_at("specs", F.lit("type"))).alias("spec_type"),
                                        F.element_at("specs", F.lit("size")).alias("spec_size"))


@query("duplicate_categories", oracle="""
SELECT p_partkey AS product_id, p_name AS name, p_type AS parent FROM part a
WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_name = a.p_name AND b.p_type = a.p_type AND b.p_partkey <> a.p_partkey)""")
def duplicate_categories(fx):
    """Same name and parent under another id."""
    items = fx.part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
                           F.col("p_type").alias("parent"))
    return cg.duplicate_siblings(items, "product_id", "name", "parent")


# -- cart ------------------------------------------------------------------
CART_EV_SQL = """
SELECT b.event_id, b.user_id, b.item_id, b.action, b.ts, i.item_name AS name,
       CAST(round(i.price * 100) AS BIGINT) AS price_cents
FROM behaviors b LEFT JOIN items i USING (item_id) WHERE b.action IN ('add_to_cart', 'purchase')"""
OPEN_LINES_SQL = f"""
WITH ev AS ({CART_EV_SQL}),
lb AS (SELECT user_id, item_id, max(ts) AS bought FROM ev WHERE action = 'purchase' GROUP BY ALL)
SELECT a.user_id, a.item_id, count(*) AS quantity, arg_max(a.price_cents, a.ts) AS price_cents, max(a.ts) AS last_ts
FROM ev a LEFT JOIN lb USING (user_id, item_id)
WHERE a.action = 'add_to_cart' AND (lb.bought IS NULL OR a.ts > lb.bought) GROUP BY ALL"""
TOTALS_SQL = f"""
SELECT user_id, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS items,
       CAST(sum(quantity * price_cents) AS DOUBLE) / 100.0e0 AS total_price, max(last_ts) AS last_ts
FROM ({OPEN_LINES_SQL}) GROUP BY user_id"""
CART_VIEWS = ("behaviors", "items")


def _cart_ev(fx):
    return ct.cart_events(fx.behaviors, fx.items)


@query("cart_totals", views=CART_VIEWS, oracle=TOTALS_SQL)
def cart_totals(fx):
    """Open cart lines, items and total per user."""
    return ct.cart_totals(ct.open_lines(_cart_ev(fx)))


@query("merge_carts", views=CART_VIEWS, oracle=f"""
WITH ev AS ({CART_EV_SQL})
SELECT user_id, item_id, CAST(count(*) AS BIGINT) AS quantity, arg_max(price_cents, ts) AS price_cents
FROM ev WHERE action = 'add_to_cart' GROUP BY ALL""")
def merge_carts(fx):
    """Session cart (odd ids) merged into the user cart (even ids)."""
    adds = _cart_ev(fx).where(F.col("action") == "add_to_cart").select(
        "user_id", "item_id", F.lit(1).cast("bigint").alias("quantity"), "price_cents", "ts",
        (F.col("event_id") % 2).alias("_odd"))
    user_cart = adds.where(F.col("_odd") == 0).drop("_odd")
    session_cart = adds.where(F.col("_odd") == 1).drop("_odd")
    return ct.merge_carts(user_cart, session_cart)


@query("apply_coupons", views=CART_VIEWS, oracle=f"""
WITH t AS ({TOTALS_SQL}),
cp(code, percent, valid_from, valid_to) AS (VALUES
  ('C10', 10, TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-12-31 23:59:59'),
  ('C20', 20, TIMESTAMP '2023-01-01 00:00:00', TIMESTAMP '2023-12-31 23:59:59'),
  ('C30', 30, TIMESTAMP '2025-01-01 00:00:00', TIMESTAMP '2025-12-31 23:59:59')),
a AS (SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'C10' WHEN 1 THEN 'C20' WHEN 2 THEN 'C30' END AS code FROM t),
j AS (SELECT t.user_id, cp.code, t.total_price,
             CASE WHEN cp.code IS NULL THEN 'none' WHEN t.last_ts < cp.valid_from THEN 'not_yet_valid'
                  WHEN t.last_ts > cp.valid_to THEN 'expired' ELSE 'applied' END AS status, cp.percent
      FROM t JOIN a USING (user_id) LEFT JOIN cp ON cp.code = a.code)
SELECT user_id, code AS coupon_code, status, total_price,
       round(total_price * 100) * (100 - CASE WHEN status = 'applied' THEN percent ELSE 0 END) / 10000.0e0
         AS discounted_total
FROM j""")
def apply_coupons(fx):
    """Coupon (user_id % 4) applied when valid at the cart's last event."""
    totals = ct.cart_totals(ct.open_lines(_cart_ev(fx)))
    assigned = totals.select("user_id", F.when(F.col("user_id") % 4 == 0, "C10")
                             .when(F.col("user_id") % 4 == 1, "C20")
                             .when(F.col("user_id") % 4 == 2, "C30").alias("code"))
    return ct.apply_coupons(totals, assigned, ct.coupons_df(fx.spark))


@query("unpaid_timeouts", views=CART_VIEWS, oracle="""
SELECT a.event_id, a.user_id, a.item_id, a.ts FROM behaviors a
WHERE a.action = 'add_to_cart' AND NOT EXISTS (
  SELECT 1 FROM behaviors p WHERE p.user_id = a.user_id AND p.action = 'purchase'
    AND p.ts > a.ts AND p.ts <= a.ts + INTERVAL 15 MINUTE)""")
def unpaid_timeouts(fx):
    """Orders (add_to_cart) not paid (purchase) within 15 minutes."""
    b = fx.behaviors
    starts = b.where(F.col("action") == "add_to_cart").select("event_id", "user_id", "item_id", "ts")
    paid = b.where(F.col("action") == "purchase").select("user_id", "ts")
    return ct.unanswered(starts, paid, "user_id", 15 * 60)


@query("abandoned_carts", views=("behaviors", "as_of_t"), oracle="""
SELECT a.event_id, a.user_id, a.item_id, a.ts FROM behaviors a
WHERE a.action = 'add_to_cart' AND a.ts <= (SELECT as_of FROM as_of_t) - INTERVAL 1 DAY AND NOT EXISTS (
  SELECT 1 FROM behaviors p WHERE p.user_id = a.user_id AND p.action = 'purchase'
    AND p.ts > a.ts AND p.ts <= a.ts + INTERVAL 1 DAY)""")
def abandoned_carts(fx):
    """Cart adds older than 1 day with no purchase within 1 day."""
    b = fx.behaviors
    starts = (b.where((F.col("action") == "add_to_cart") & (F.col("ts") <= fx.as_of - F.expr("INTERVAL 1 DAY")))
               .select("event_id", "user_id", "item_id", "ts"))
    paid = b.where(F.col("action") == "purchase").select("user_id", "ts")
    return ct.unanswered(starts, paid, "user_id", 86400)


@query("checkout_funnel", oracle="""
WITH s AS (SELECT o_orderkey, 1 AS submitted, CAST(o_orderstatus IN ('P', 'F') AS INTEGER) AS reserved,
                  CAST(o_orderstatus = 'F' AS INTEGER) AS paid,
                  CAST(o_orderstatus = 'O' AND o_orderpriority = '5-LOW' AS INTEGER) AS aborted FROM orders)
SELECT CASE WHEN paid = 1 THEN 'paid' WHEN aborted = 1 THEN 'aborted' WHEN reserved = 1 THEN 'reserved'
            ELSE 'submitted' END AS terminal_state,
       count(*) AS orders, CAST(sum(submitted) AS BIGINT) AS submitted, CAST(sum(reserved) AS BIGINT) AS reserved,
       CAST(sum(paid) AS BIGINT) AS paid, CAST(sum(aborted) AS BIGINT) AS aborted, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM orders) AS share
FROM s GROUP BY 1""")
def checkout_funnel(fx):
    """Checkout saga terminal states and stage counts."""
    return ct.checkout_funnel(fx.orders)


@query("cart_history", views=("behaviors", "items", "as_of_t"), oracle=f"""
SELECT event_id, user_id, item_id, action, ts FROM ({CART_EV_SQL})
WHERE ts > (SELECT as_of FROM as_of_t) - INTERVAL 24 HOUR AND ts <= (SELECT as_of FROM as_of_t)""")
def cart_history(fx):
    """ST7 batch twin: cart events in the 24 h before as_of."""
    return ct.cart_history(_cart_ev(fx), fx.as_of).select("event_id", "user_id", "item_id", "action", "ts")


@query("validate_cart_lines", views=CART_VIEWS, oracle=f"""
WITH l AS (SELECT event_id, item_id AS sku, name, price_cents, 1 AS quantity FROM ({CART_EV_SQL})
           WHERE action = 'add_to_cart')
SELECT event_id, array_to_string(list_filter([
         CASE WHEN coalesce(length(trim(CAST(sku AS VARCHAR))) = 0, true) THEN 'sku_blank' END,
         CASE WHEN coalesce(length(trim(name)) = 0, true) THEN 'name_blank' END,
         CASE WHEN price_cents IS NULL THEN 'price_missing' END,
         CASE WHEN coalesce(quantity < 1, true) THEN 'quantity_below_one' END], lambda x: x IS NOT NULL), ',')
         AS reasons,
       sku IS NOT NULL AND name IS NOT NULL AND length(trim(name)) > 0 AND price_cents IS NOT NULL AS valid
FROM l""")
def validate_cart_lines(fx):
    """Cart-line validation (sku, name, price, quantity)."""
    lines = _cart_ev(fx).where(F.col("action") == "add_to_cart").select(
        "event_id", F.col("item_id").alias("sku"), "name", F.col("price_cents").alias("price"),
        F.lit(1).alias("quantity"))
    return cg.validate_cart_lines(lines).select("event_id", "reasons", "valid")


@query("category_search", oracle="""
WITH cats AS (
  SELECT CAST(r_regionkey AS BIGINT) AS category_id, r_name AS name, CAST(NULL AS BIGINT) AS parent_id FROM region
  UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), n_name, CAST(n_regionkey AS BIGINT) FROM nation)
SELECT category_id, name, parent_id FROM cats WHERE contains(lower(name), 'ion_1')""")
def category_search(fx):
    """Category name search (case-insensitive substring)."""
    c = cg.categories(fx.region, fx.nation)
    return c.where(F.lower(F.col("name")).contains("ion_1"))
