"""Registered stock jobs (T1-T7) and the statement runner."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larder.operators import changes as U
from larder.operators import history as H
from larder.operators import stock as T
from larder.plans.oracle_sql import PREFIX
from larder.plans.registry import SQL, register
from larder.session import scratch_path
from larder.sources import catalog, commits, sinks, testdata
from larder.streaming import stock_stream as S

D = "AS DOUBLE)"


@register("apply_purchases", f"""
SELECT i.ingredient_id, CAST(i.quantity + coalesce(p.q, 0) {D} AS quantity
FROM ingredients i
LEFT JOIN (SELECT ingredient_id, sum(quantity) AS q FROM purchases GROUP BY 1) p
  ON p.ingredient_id = i.ingredient_id""")
def _apply_purchases(t):
    return T.apply_purchases(t.ingredients, t.purchases).select("ingredient_id", "quantity")


@register("apply_order_items", f"""
SELECT i.ingredient_id, CAST(i.quantity - coalesce(u.used, 0) {D} AS quantity
FROM ingredients i
LEFT JOIN (SELECT r.ingredient_id, sum(r.qty_required * s.q) AS used
           FROM (SELECT menu_id, sum(quantity) AS q FROM order_items GROUP BY 1) s
           JOIN recipes r ON r.menu_id = s.menu_id GROUP BY 1) u
  ON u.ingredient_id = i.ingredient_id""")
def _apply_order_items(t):
    ing, _ = T.apply_order_items(t.ingredients, t.orders, t.order_items, t.recipes)
    return ing.select("ingredient_id", "quantity")


@register("apply_order_items_totals", f"""
SELECT o.order_id, CAST(o.total_amount + coalesce(l.s, 0) {D} AS total_amount
FROM orders o LEFT JOIN (SELECT order_id, sum(price * quantity) AS s FROM order_items GROUP BY 1) l
  ON l.order_id = o.order_id""")
def _apply_order_items_totals(t):
    _, orders = T.apply_order_items(t.ingredients, t.orders, t.order_items, t.recipes)
    return orders.select("order_id", "total_amount")


def order_requests(t):
    """Requests to place: one per order's cart, in order-id sequence."""
    o = t.orders.select(F.col("order_id").alias("cart_id"), "customer_id",
                        F.col("order_date").alias("ts"))
    return (o.join(t.carts, "cart_id", "left")
             .select(F.col("cart_id").alias("seq"), "customer_id", "ts", "cart"))


# Oracle for admission: a plain serial simulation in SQL.  Only "contended"
# ingredients (opening stock below the total demand of all candidate orders)
# can refuse an order, so the recursive walk visits just the orders that use
# one, in seq order, carrying their balances in a map.
_T3_EXTRA = """,
req AS (SELECT order_id AS seq, customer_id, order_date AS ts FROM orders),
lines AS (SELECT cart_id AS seq, menu_id, qty FROM cart_lines),
chk AS (SELECT r.seq, count(l.menu_id) AS nlines,
               count_if(m.menu_id IS NULL OR m.is_available <> 1) AS nbad,
               count_if(l.menu_id IS NOT NULL AND NOT coalesce(l.qty > 0, false)) AS nneg,
               sum(round(m.price - m.price * m.discount * 0.01, 2) * l.qty) AS total
        FROM req r LEFT JOIN lines l ON l.seq = r.seq
        LEFT JOIN menu_items m ON m.menu_id = l.menu_id
        GROUP BY r.seq),
cand AS (SELECT seq FROM chk WHERE nlines > 0 AND nbad = 0 AND nneg = 0),
needs AS (SELECT l.seq, r.ingredient_id, sum(r.qty_required * l.qty) AS need
          FROM lines l JOIN cand c ON c.seq = l.seq JOIN recipes r ON r.menu_id = l.menu_id
          GROUP BY 1, 2),
opening AS (SELECT i.ingredient_id, i.quantity + coalesce(p.q, 0) AS q FROM ingredients i
            LEFT JOIN (SELECT ingredient_id, sum(quantity) AS q FROM purchases GROUP BY 1) p
              ON p.ingredient_id = i.ingredient_id),
contended AS (SELECT t.ingredient_id, CAST(coalesce(o.q, 0) AS DECIMAL(18,4)) AS q
              FROM (SELECT ingredient_id, sum(need) AS total FROM needs GROUP BY 1) t
              LEFT JOIN opening o ON o.ingredient_id = t.ingredient_id
              WHERE coalesce(o.q, 0) < t.total),
creq AS (SELECT seq, row_number() OVER (ORDER BY seq) AS rn
         FROM (SELECT DISTINCT seq FROM needs
               WHERE ingredient_id IN (SELECT ingredient_id FROM contended))),
cn AS (SELECT c.rn, n.ingredient_id, CAST(n.need AS DECIMAL(18,4)) AS need
       FROM needs n JOIN creq c ON c.seq = n.seq
       WHERE n.ingredient_id IN (SELECT ingredient_id FROM contended)),
sim AS (
  WITH RECURSIVE s(rn, bal, ok) AS (
    SELECT 0, (SELECT map_from_entries(list({'k': ingredient_id, 'v': q})) FROM contended), true
    UNION ALL
    SELECT s.rn + 1,
           CASE WHEN (SELECT bool_and(s.bal[cn.ingredient_id] - cn.need >= 0) FROM cn
                      WHERE cn.rn = s.rn + 1)
                THEN map_concat(s.bal, (SELECT map_from_entries(list({'k': cn.ingredient_id,
                       'v': CAST(s.bal[cn.ingredient_id] - cn.need AS DECIMAL(18,4))}))
                                        FROM cn WHERE cn.rn = s.rn + 1))
                ELSE s.bal END,
           (SELECT bool_and(s.bal[cn.ingredient_id] - cn.need >= 0) FROM cn
            WHERE cn.rn = s.rn + 1)
    FROM s WHERE s.rn < (SELECT count(*) FROM creq))
  SELECT c.seq, s.ok FROM s JOIN creq c ON c.rn = s.rn),
outc AS (SELECT r.seq, r.customer_id, r.ts,
                CASE WHEN k.nlines = 0 THEN 'empty cart'
                     WHEN k.nbad > 0 THEN 'item not available'
                     WHEN k.nneg > 0 THEN 'quantity must be above 0'
                     WHEN sim.ok = false THEN 'not enough stock' END AS reason, k.total
         FROM req r JOIN chk k ON k.seq = r.seq LEFT JOIN sim ON sim.seq = r.seq)"""

_T3_SELECT = """
SELECT seq, customer_id, reason IS NULL AS accepted, reason,
       CASE WHEN reason IS NULL THEN (SELECT max(order_id) FROM orders)
            + row_number() OVER (PARTITION BY reason IS NULL ORDER BY seq) END AS order_id,
       CAST(CASE WHEN reason IS NULL THEN total END AS DOUBLE) AS total
FROM outc"""


def _placed(t):
    """The tables after one committed run of order admission over all carts.  The run is
    made once for a set of tables; the keys below read what it committed."""
    if "_placed" not in t._cache:
        store = commits.Store(t.spark, _run_dir(t, "placed"))
        opening = T.apply_purchases(t.ingredients, t.purchases)
        store.commit(store.snapshot(), replace={"ingredients": opening, "orders": t.orders, "order_items": t.order_items})
        T.commit_orders(store, order_requests(t), t.menu_items, t.recipes, t.employees, batch="carts")
        t._cache["_placed"] = store
    return t._cache["_placed"].snapshot()


def _new(t, table, key):
    """Rows of ``table`` that the run added: ids above those that the table had in the first commit."""
    now = _placed(t)
    had = t._cache["_placed"].snapshot(0).read(table)
    return now.read(table).filter(F.col(key) > had.select(F.max(key)).scalar())


@register("place_orders", _T3_SELECT, extra_ctes=_T3_EXTRA)
def _place_orders(t):
    return _placed(t).read("outcomes")


_T3_IDS = _T3_EXTRA + """,
acc AS (SELECT seq, customer_id, ts, total, (SELECT max(order_id) FROM orders)
               + row_number() OVER (ORDER BY seq) AS order_id FROM outc WHERE reason IS NULL)"""


@register("place_orders_orders", f"""
SELECT order_id, customer_id,
       (SELECT min(employee_id) FROM employees WHERE role = 'Waiter') AS employee_id,
       ts AS order_date, 'Pending' AS status, CAST(total {D} AS total_amount FROM acc""",
          extra_ctes=_T3_IDS)
def _place_orders_orders(t):
    return _new(t, "orders", "order_id")


@register("place_orders_lines", f"""
SELECT (SELECT max(order_item_id) FROM order_items) + row_number() OVER (ORDER BY a.seq, l.menu_id)
         AS order_item_id,
       a.order_id, l.menu_id, l.qty AS quantity,
       CAST(round(m.price - m.price * m.discount * 0.01, 2) {D} AS price
FROM acc a JOIN lines l ON l.seq = a.seq JOIN menu_items m ON m.menu_id = l.menu_id""",
          extra_ctes=_T3_IDS)
def _place_orders_lines(t):
    return _new(t, "order_items", "order_item_id").select("order_item_id", "order_id", "menu_id", "quantity",
                                                          "price")


@register("place_orders_stock", f"""
SELECT i.ingredient_id,
       CAST(i.quantity + coalesce(p.q, 0) - coalesce(u.used, 0) {D} AS quantity
FROM ingredients i
LEFT JOIN (SELECT ingredient_id, sum(quantity) AS q FROM purchases GROUP BY 1) p
  ON p.ingredient_id = i.ingredient_id
LEFT JOIN (SELECT n.ingredient_id, sum(n.need) AS used FROM needs n JOIN acc ON acc.seq = n.seq
           GROUP BY 1) u ON u.ingredient_id = i.ingredient_id""", extra_ctes=_T3_IDS)
def _place_orders_stock(t):
    return _placed(t).read("ingredients").select("ingredient_id", "quantity")


@register("price_as_of", f"""
SELECT v.order_item_id, v.menu_id, v.order_date,
       CAST(CASE WHEN p.is_available = 1 THEN round(p.price - p.price * p.discount * 0.01, 2) END
            {D} AS price,
       coalesce(p.is_available = 1, false) AS available
FROM v LEFT JOIN price_log p ON p.menu_id = v.menu_id AND p.valid_from = v.vf""", extra_ctes=""",
l AS (SELECT oi.order_item_id, oi.menu_id, o.order_date
      FROM order_items oi JOIN orders o ON o.order_id = oi.order_id),
v AS (SELECT l.*, (SELECT max(p.valid_from) FROM price_log p
                   WHERE p.menu_id = l.menu_id AND p.valid_from <= l.order_date) AS vf FROM l)""")
def _price_as_of(t):
    return T.price_as_of(_dated_lines(t), t.price_log)


def _dated_lines(t):
    return t.order_items.select("order_item_id", "order_id", "menu_id").join(
        t.orders.select("order_id", "order_date"), "order_id").drop("order_id")


def _history(t):
    """The price history after three batches of changes, the last of them late."""
    at = F.year("valid_from")
    h = H.build_history(t.price_log.filter(at < 1995))
    for year in (1999, 1997):
        h = H.merge_history(h, t.price_log.filter(at == year))
    return h


@register("price_history", f"""
SELECT menu_id, valid_from, lead(valid_from) OVER (PARTITION BY menu_id ORDER BY valid_from) AS valid_to,
       CAST(price {D} AS price, CAST(discount {D} AS discount, is_available FROM price_log""")
def _price_history(t):
    return _history(t)


@register("price_from_history", SQL["price_as_of"].removeprefix(PREFIX))
def _price_from_history(t):
    return H.price_from_history(_dated_lines(t), _history(t))


# ------------------------------------------------------------------ streams over `events`

def _stream(t, table):
    """A driver table as a stream, whether one file or a folder of files (a
    plain path must be a folder for the file source; a pattern may match either)."""
    return (t.spark.readStream.schema(t.source(table).schema)
            .parquet(f"{t.sf_dir.rstrip('/')}/{table}.parque[t]"))


def _stream_events(t):
    return _stream(t, "events")


def _event_moves(t):
    """Streaming movements from the events table: 'purchase' adds value,
    'click' takes it away, keyed by user_id as the ingredient."""
    ev = _stream_events(t).filter(F.col("event_type").isin("purchase", "click"))
    amount = F.col("value").cast("decimal(12,2)")
    return ev.select(F.col("user_id").alias("ingredient_id"), "ts",
                     F.col("event_id").alias("ref"),
                     F.when(F.col("event_type") == "purchase", amount).otherwise(-amount)
                      .alias("delta"))


def _run_dir(t, name):
    return scratch_path(t.spark, f"streams/{name}-{uuid.uuid4().hex}")


def _empty_opening(t):
    return t.spark.createDataFrame([], "ingredient_id long, quantity decimal(20,2)")


_MOVES_SQL = """,
m AS (SELECT user_id AS ingredient_id, ts, event_id AS ref,
             CAST(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(12,2))
                       ELSE -CAST(value AS DECIMAL(12,2)) END AS DECIMAL(12,2)) AS delta
      FROM events WHERE event_type IN ('purchase', 'click'))"""


@register("stream_stock", f"""
SELECT ingredient_id, CAST(sum(delta) {D} AS quantity FROM m GROUP BY 1""",
          extra_ctes=_MOVES_SQL)
def _stream_stock(t):
    base = _run_dir(t, "stock")
    q = S.stream_stock(_event_moves(t), f"{base}/state", f"{base}/ckpt")
    q.awaitTermination()
    return S.read_balances(t.spark, f"{base}/state", _empty_opening(t))


def _sales(t):
    """The state of a run over raw purchases and order lines."""
    base = _run_dir(t, "sales")
    S.stream_sales(testdata.buys_of(_stream(t, "lineitem")), testdata.lines_of(_stream(t, "lineitem")), t.recipes,
                   f"{base}/state", f"{base}/ckpt").awaitTermination()
    return f"{base}/state"


@register("stream_stock_raw", f"""
SELECT i.ingredient_id, CAST(i.quantity + coalesce(p.q, 0) - coalesce(u.used, 0) {D} AS quantity
FROM ingredients i
LEFT JOIN (SELECT ingredient_id, sum(quantity) AS q FROM purchases GROUP BY 1) p
  ON p.ingredient_id = i.ingredient_id
LEFT JOIN (SELECT r.ingredient_id, sum(r.qty_required * s.q) AS used
           FROM (SELECT menu_id, sum(quantity) AS q FROM order_items GROUP BY 1) s
           JOIN recipes r ON r.menu_id = s.menu_id GROUP BY 1) u
  ON u.ingredient_id = i.ingredient_id""")
def _stream_stock_raw(t):
    return S.read_stock(t.spark, _sales(t), t.ingredients).select("ingredient_id", "quantity")


@register("stream_order_totals", SQL["apply_order_items_totals"].removeprefix(PREFIX))
def _stream_order_totals(t):
    return S.read_order_totals(t.spark, _sales(t), t.orders).select("order_id", "total_amount")


@register("stream_sales_view", f"""
SELECT CAST(CAST(order_date AS DATE) AS TIMESTAMP) AS day, count(*) AS total_orders,
       CAST(sum(total_amount) {D} AS total_sales
FROM fold WHERE status = 'Paid' GROUP BY 1""", extra_ctes=""",
ev AS (SELECT o.order_id, c.seq, c.status AS st, o.status AS init, c.actor = 'staff' AS staff
       FROM status_changes c JOIN orders o ON o.order_id = c.order_id
       WHERE (c.actor = 'staff' AND c.status IN ('Pending', 'Served', 'Paid', 'Cancelled'))
          OR (c.actor = 'customer' AND c.status = 'Cancelled' AND c.customer_id = o.customer_id)),
step AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY seq) AS k FROM ev),
walk AS (
  WITH RECURSIVE w AS (
    SELECT order_id, k, CASE WHEN staff THEN st WHEN init = 'Pending' THEN 'Cancelled' ELSE init END AS status
    FROM step WHERE k = 1
    UNION ALL
    SELECT s.order_id, s.k, CASE WHEN s.staff THEN s.st WHEN w.status = 'Pending' THEN 'Cancelled' ELSE w.status END
    FROM w JOIN step s ON s.order_id = w.order_id AND s.k = w.k + 1)
  SELECT * FROM w),
fold AS (SELECT o.order_id, o.order_date, o.total_amount, coalesce(l.status, o.status) AS status
         FROM orders o LEFT JOIN (SELECT order_id, max_by(status, k) AS status FROM walk GROUP BY 1) l
           ON l.order_id = o.order_id)""")
def _stream_sales_view(t):
    base = _run_dir(t, "view")
    events = S.order_events(testdata.orders_of(_stream(t, "orders")), testdata.status_changes_of(_stream(t, "orders")))
    S.stream_sales_view(events, f"{base}/state", f"{base}/ckpt").awaitTermination()
    return S.read_sales_view(t.spark, f"{base}/state")


@register("stream_daily_sales", f"""
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, count(*) AS total_orders,
       CAST(sum(CAST(value AS DECIMAL(12,2))) {D} AS total_sales
FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def _stream_daily_sales(t):
    base = _run_dir(t, "daily")
    sales = (_stream_events(t).filter(F.col("event_type") == "purchase")
             .select("ts", F.col("value").cast("decimal(12,2)").alias("amount")))
    q = S.stream_daily_sales(sales, f"{base}/state", f"{base}/ckpt")
    q.awaitTermination()
    return S.read_daily_sales(t.spark, f"{base}/state")


def _levels(t):
    """Reorder level per user-as-ingredient: 100 + 50 × (user_id mod 5)."""
    return (t.source("events").select(F.col("user_id").alias("ingredient_id")).distinct()
             .select("ingredient_id",
                     (F.lit(100) + F.col("ingredient_id") % 5 * 50).cast("decimal(10,2)")
                     .alias("reorder_level")))


@register("stream_low_stock", f"""
SELECT ingredient_id, ts, ref, CAST(after - delta {D} AS before, CAST(after {D} AS after,
       CAST(100 + ingredient_id % 5 * 50 {D} AS reorder_level
FROM r
WHERE after - delta > 100 + ingredient_id % 5 * 50 AND after <= 100 + ingredient_id % 5 * 50""",
          extra_ctes=_MOVES_SQL + """,
r AS (SELECT *, sum(delta) OVER (PARTITION BY ingredient_id ORDER BY ts, ref
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after
      FROM m)""")
def _stream_low_stock(t):
    base = _run_dir(t, "low")
    q = S.stream_low_stock(_event_moves(t), _levels(t), _empty_opening(t), f"{base}/state",
                           f"{base}/alerts", f"{base}/ckpt")
    q.awaitTermination()
    return S.read_alerts(t.spark, f"{base}/alerts")


# ------------------------------------------------------------------ S7

_SCRIPT = """
CREATE OR REPLACE TEMP VIEW paid_orders AS SELECT * FROM orders WHERE status = 'Paid';
-- a comment; with a semicolon
SELECT employee_id, count(*) AS n, CAST(sum(total_amount) AS DOUBLE) AS total,
       'a;b' AS note
FROM paid_orders GROUP BY employee_id
"""


@register("sql_script", """
SELECT employee_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(total_amount) AS DOUBLE) AS total,
       'a;b' AS note
FROM orders WHERE status = 'Paid' GROUP BY employee_id""")
def _sql_script(t):
    catalog.register_tables(t.spark, {"orders": t.orders})
    results = catalog.sql_script(t.spark, _SCRIPT)
    errors = [r.error for r in results if r.error]
    if errors:
        raise RuntimeError(errors[0])
    return results[-1].frame


_DML = """
INSERT INTO menu_items (name, category, price) VALUES ('Fresh Soup', 'Starters', 90), ('Fresh Tea', 'Drinks', 20);
UPDATE menu_items SET price = price + 1.5, discount = 10 WHERE category LIKE '%BRASS%';
DELETE FROM orders WHERE order_id % 7 = 3;
UPDATE menu_items SET price = 0 WHERE menu_id = 1;
DELETE FROM customers WHERE customer_id % 9 = 4
"""


@register("sql_dml", f"""
SELECT 'menu_items' AS table_name, count(*) AS n, CAST(sum(price) {D} AS total, CAST(sum(discount) {D} AS other FROM menu_after
UNION ALL SELECT 'orders', count(*), CAST(sum(total_amount) {D}, CAST(count(customer_id) {D} FROM orders_after
UNION ALL SELECT 'order_items', count(*), CAST(sum(price) {D}, CAST(sum(quantity) {D} FROM order_items
  WHERE NOT (order_id % 7 = 3 AND order_id IN (SELECT order_id FROM orders))
UNION ALL SELECT 'users', count(*), CAST(sum(user_id) {D}, CAST(count(customer_id) {D} FROM users
  WHERE customer_id IS NULL OR NOT (customer_id % 9 = 4 AND customer_id IN (SELECT customer_id FROM customers))""",
          extra_ctes=""",
menu_after AS (
  SELECT price + CASE WHEN category LIKE '%BRASS%' THEN 1.5 ELSE 0 END AS price,
         CASE WHEN category LIKE '%BRASS%' THEN 10 ELSE discount END AS discount FROM menu_items
  UNION ALL SELECT 90, 0 UNION ALL SELECT 20, 0),
orders_after AS (
  SELECT total_amount, CASE WHEN customer_id % 9 = 4 AND customer_id IN (SELECT customer_id FROM customers) THEN NULL
                            ELSE customer_id END AS customer_id FROM orders WHERE NOT order_id % 7 = 3)""")
def _sql_dml(t):
    """A script of changes over stored tables; the fourth statement breaks a CHECK and changes
    nothing.  What the tables hold afterwards."""
    store = commits.Store(t.spark, _run_dir(t, "dml"))
    names = ["menu_items", "orders", "order_items", "users", "customers"]
    # names are unique as the schema asks for (the stand-in menu repeats some)
    menu = t.menu_items.withColumn("name", F.concat("name", F.lit(" #"), F.col("menu_id").cast("string")))
    store.commit(store.snapshot(), replace={n: menu if n == "menu_items" else getattr(t, n) for n in names})
    errors = [r.error for r in catalog.sql_script(t.spark, _DML, store)]
    if [e is not None for e in errors] != [False, False, False, True, False]:
        raise RuntimeError(str(errors))
    s = store.snapshot()

    def state(name, total, other):
        return s.read(name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"),
                                F.sum(total).alias("total"), other.cast("decimal(30,2)").alias("other"))
    return (state("menu_items", "price", F.sum("discount")).unionByName(state("orders", "total_amount", F.count("customer_id")))
            .unionByName(state("order_items", "price", F.sum("quantity")))
            .unionByName(state("users", "user_id", F.count("customer_id")).withColumn("total", F.col("total").cast("decimal(30,2)"))))


# ------------------------------------------------------------------ S8, S9

RUN_DATE = "2026-01-31"      # the day of the run, an input of the purchase job


@register("sink_append", f"""
SELECT purchase_id, supplier_id, ingredient_id, CAST(quantity {D} AS quantity,
       CAST(cost {D} AS cost, CAST(purchase_date AS TIMESTAMP) AS purchase_date
FROM purchases
UNION ALL
SELECT (SELECT max(purchase_id) FROM purchases) + row_number() OVER (ORDER BY seq),
       supplier_id, ingredient_id, CAST(quantity {D}, CAST(cost {D},
       CAST(coalesce(purchase_date, DATE '{RUN_DATE}') AS TIMESTAMP)
FROM new_purchases WHERE coalesce(quantity > 0, false) AND coalesce(cost >= 0, false)
  AND supplier_id IN (SELECT supplier_id FROM suppliers)
  AND ingredient_id IN (SELECT ingredient_id FROM ingredients)""")
def _sink_append(t):
    """The purchases table is written, a batch of purchase forms is checked
    (rules, keys), given ids and appended — twice, as a retried job would;
    the table is read back with its declared schema."""
    path = _run_dir(t, "append") + "/purchases"
    sinks.append(t.purchases, path, batch="0")
    ok, _ = U.purchase_insert(t.purchases, t.suppliers, t.ingredients, t.new_purchases, RUN_DATE)
    for _ in range(2):
        sinks.append(ok, path, batch="1")
    return catalog.read_table(t.spark, path, "purchases")


@register("purchase_outcomes", """
SELECT seq, CASE WHEN NOT coalesce(quantity > 0, false) THEN 'quantity must be above 0'
                 WHEN NOT coalesce(cost >= 0, false) THEN 'cost must be >= 0'
                 WHEN supplier_id NOT IN (SELECT supplier_id FROM suppliers) THEN 'supplier not found'
                 WHEN ingredient_id NOT IN (SELECT ingredient_id FROM ingredients)
                   THEN 'ingredient not found' END AS reason
FROM new_purchases""")
def _purchase_outcomes(t):
    return U.purchase_insert(t.purchases, t.suppliers, t.ingredients, t.new_purchases, RUN_DATE)[1]


@register("sink_snapshot", f"""
SELECT i.ingredient_id, CAST(i.quantity + coalesce(p.q, 0) {D} AS quantity
FROM ingredients i
LEFT JOIN (SELECT ingredient_id, sum(quantity) AS q FROM purchases GROUP BY 1) p
  ON p.ingredient_id = i.ingredient_id""")
def _sink_snapshot(t):
    """Version 0 = ingredients; version 1 = version 0 after the purchases
    (T1), written as a new version while version 0 is its input; readers get
    the latest committed version."""
    base = _run_dir(t, "snapshot")
    sinks.commit_version(t.ingredients, base, 0)
    v0 = sinks.read_latest(t.spark, base)
    sinks.commit_version(T.apply_purchases(v0, t.purchases), base, 1)
    return sinks.read_latest(t.spark, base).select("ingredient_id", "quantity")
