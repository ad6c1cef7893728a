"""Registered change jobs (U1-U11) and window jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from larder.operators import changes as U
from larder.operators import referential as R
from larder.operators import windows as W
from larder.plans.registry import register
from larder.schemas import SCHEMAS

D = "AS DOUBLE)"
_ORDER_OUT = f"""o.order_id, o.customer_id, o.employee_id, o.order_date,
       coalesce(l.status, o.status) AS status, CAST(o.total_amount {D} AS total_amount"""
_VALID = "('Pending', 'Served', 'Paid', 'Cancelled')"

# ------------------------------------------------------------------ U1


@register("menu_insert", """
SELECT seq, name,
       CASE WHEN reason IS NULL THEN (SELECT max(menu_id) FROM menu_items)
            + row_number() OVER (PARTITION BY reason IS NULL ORDER BY seq) END AS menu_id,
       reason
FROM f""", extra_ctes=""",
a AS (SELECT seq, trim(name) AS name, price, discount FROM menu_changes WHERE op = 'add'),
r AS (SELECT *, CASE WHEN length(trim(coalesce(name, ''))) = 0 THEN 'name is empty'
                     WHEN NOT coalesce(price > 0, false) THEN 'price must be above 0'
                     WHEN NOT coalesce(discount >= 0 AND discount <= 100, false)
                       THEN 'discount must be 0..100'
                     WHEN name IN (SELECT name FROM menu_items) THEN 'name exists' END AS r0
      FROM a),
f AS (SELECT *, CASE WHEN r0 IS NULL AND seq > min(CASE WHEN r0 IS NULL THEN seq END)
                                           OVER (PARTITION BY name)
                     THEN 'duplicate name in batch' ELSE r0 END AS reason FROM r)""")
def _menu_insert(t):
    adds = t.menu_changes.filter(F.col("op") == "add")
    _, outcomes = U.menu_insert(t.menu_items, adds)
    return outcomes


# ------------------------------------------------------------------ U2

@register("menu_update", f"""
SELECT m.menu_id, m.name, m.category, CAST(coalesce(l.price, m.price) {D} AS price,
       CAST(CASE WHEN l.menu_id IS NULL THEN m.discount ELSE l.discount END {D} AS discount,
       CASE WHEN l.menu_id IS NULL THEN m.is_available ELSE coalesce(l.is_available, 0) END
         AS is_available
FROM menu_items m LEFT JOIN l ON m.menu_id = l.menu_id""", extra_ctes=""",
u AS (SELECT * FROM menu_changes WHERE op = 'update' AND coalesce(price > 0, false)
      AND coalesce(discount >= 0 AND discount <= 100, false)),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY menu_id ORDER BY seq DESC) AS rn
                     FROM u) WHERE rn = 1)""")
def _menu_update(t):
    return U.menu_update(t.menu_items, t.menu_changes.filter(F.col("op") == "update"))


# ------------------------------------------------------------------ U3

@register("category_price_up", f"""
SELECT menu_id, name, category,
       CAST(CASE WHEN category = 'PROMO' THEN CAST(price * 1.10 AS DECIMAL(10,2)) ELSE price END
            {D} AS price,
       CAST(discount {D} AS discount, is_available
FROM menu_items""")
def _category_price_up(t):
    return U.category_price_up(t.menu_items, "PROMO")


# ------------------------------------------------------------------ U4

@register("menu_delete", """
SELECT seq, menu_id,
       CASE WHEN menu_id NOT IN (SELECT menu_id FROM menu_items) THEN 'not found'
            WHEN menu_id IN (SELECT menu_id FROM order_items) THEN 'refused: sold before'
            WHEN seq > (SELECT min(d2.seq) FROM menu_changes d2
                        WHERE d2.op = 'delete' AND d2.menu_id = d.menu_id) THEN 'not found'
            ELSE 'deleted' END AS outcome
FROM menu_changes d WHERE op = 'delete'""")
def _menu_delete(t):
    req = t.menu_changes.filter(F.col("op") == "delete").select("seq", "menu_id")
    _, _, out = U.menu_delete(t.menu_items, t.recipes, t.order_items, req)
    return out


# ------------------------------------------------------------------ U5

@register("ingredient_change", f"""
SELECT ingredient_id, name, unit, CAST(quantity {D} AS quantity,
       CAST(reorder_level {D} AS reorder_level, CAST(unit_price {D} AS unit_price, supplier_id
FROM t2 WHERE ingredient_id NOT IN (SELECT ingredient_id FROM gone)""", extra_ctes=""",
pre_del AS (SELECT ingredient_id, min(seq) AS del_seq FROM ingredient_changes
            WHERE op = 'delete' AND ingredient_id IN (SELECT ingredient_id FROM ingredients)
              AND ingredient_id NOT IN (SELECT ingredient_id FROM purchases)
              AND ingredient_id NOT IN (SELECT ingredient_id FROM recipes)
            GROUP BY 1),
adds AS (SELECT seq, trim(name) AS name, unit, quantity, reorder_level, unit_price, supplier_id
         FROM ingredient_changes WHERE op = 'add'),
ar AS (SELECT *, CASE WHEN length(trim(coalesce(name, ''))) = 0 THEN 'name is empty'
                      WHEN NOT coalesce(quantity >= 0, false) THEN 'quantity'
                      WHEN NOT coalesce(unit_price >= 0, false) THEN 'unit_price'
                      WHEN EXISTS (SELECT 1 FROM ingredients i
                                   LEFT JOIN pre_del d ON d.ingredient_id = i.ingredient_id
                                   WHERE i.name = adds.name
                                     AND (d.del_seq IS NULL OR d.del_seq > adds.seq))
                        THEN 'name exists' END AS r0
       FROM adds),
af AS (SELECT *, CASE WHEN r0 IS NULL AND seq > min(CASE WHEN r0 IS NULL THEN seq END)
                                            OVER (PARTITION BY name)
                      THEN 'duplicate' ELSE r0 END AS reason FROM ar),
acc AS (SELECT (SELECT max(ingredient_id) FROM ingredients) + row_number() OVER (ORDER BY seq)
                 AS ingredient_id, seq AS add_seq, name, unit, quantity, reorder_level,
               unit_price, supplier_id
        FROM af WHERE reason IS NULL),
t1 AS (SELECT ingredient_id, name, unit, quantity, reorder_level, unit_price, supplier_id
       FROM ingredients
       UNION ALL
       SELECT ingredient_id, name, unit, quantity, reorder_level, unit_price, supplier_id
       FROM acc),
ups AS (SELECT * FROM (SELECT u.seq, u.ingredient_id, u.quantity, u.reorder_level, u.unit_price,
                              row_number() OVER (PARTITION BY u.ingredient_id
                                                 ORDER BY u.seq DESC) AS rn
                       FROM ingredient_changes u
                       LEFT JOIN acc a ON a.ingredient_id = u.ingredient_id
                       WHERE u.op = 'update' AND coalesce(u.quantity >= 0, false)
                         AND coalesce(u.reorder_level >= 0, false)
                         AND coalesce(u.unit_price >= 0, false)
                         AND (a.add_seq IS NULL OR u.seq > a.add_seq)) WHERE rn = 1),
t2 AS (SELECT t.ingredient_id, t.name, t.unit, coalesce(u.quantity, t.quantity) AS quantity,
              coalesce(u.reorder_level, t.reorder_level) AS reorder_level,
              coalesce(u.unit_price, t.unit_price) AS unit_price, t.supplier_id
       FROM t1 t LEFT JOIN ups u ON t.ingredient_id = u.ingredient_id),
new_del AS (SELECT d.ingredient_id FROM ingredient_changes d
            JOIN acc a ON a.ingredient_id = d.ingredient_id
            WHERE d.op = 'delete' AND d.seq > a.add_seq
              AND d.ingredient_id NOT IN (SELECT ingredient_id FROM ingredients)),
gone AS (SELECT ingredient_id FROM pre_del UNION SELECT ingredient_id FROM new_del)""")
def _ingredient_change(t):
    table, _ = U.ingredient_change(t.ingredients, t.purchases, t.recipes, t.ingredient_changes)
    return table


@register("apply_menu_changes", f"""
SELECT menu_id, name, category, CAST(price {D} AS price, CAST(discount {D} AS discount,
       is_available
FROM t2 WHERE menu_id NOT IN (SELECT menu_id FROM gone)""", extra_ctes=""",
pre_del AS (SELECT menu_id, min(seq) AS del_seq FROM menu_changes
            WHERE op = 'delete' AND menu_id IN (SELECT menu_id FROM menu_items)
              AND menu_id NOT IN (SELECT menu_id FROM order_items)
            GROUP BY 1),
a AS (SELECT seq, trim(name) AS name, category, price, discount FROM menu_changes
      WHERE op = 'add'),
r AS (SELECT *, CASE WHEN length(trim(coalesce(name, ''))) = 0 THEN 'name is empty'
                     WHEN NOT coalesce(price > 0, false) THEN 'price must be above 0'
                     WHEN NOT coalesce(discount >= 0 AND discount <= 100, false)
                       THEN 'discount must be 0..100'
                     WHEN EXISTS (SELECT 1 FROM menu_items m
                                  LEFT JOIN pre_del d ON d.menu_id = m.menu_id
                                  WHERE m.name = a.name
                                    AND (d.del_seq IS NULL OR d.del_seq > a.seq))
                       THEN 'name exists' END AS r0
      FROM a),
f AS (SELECT *, CASE WHEN r0 IS NULL AND seq > min(CASE WHEN r0 IS NULL THEN seq END)
                                           OVER (PARTITION BY name)
                     THEN 'duplicate' ELSE r0 END AS reason FROM r),
acc AS (SELECT (SELECT max(menu_id) FROM menu_items) + row_number() OVER (ORDER BY seq)
                 AS menu_id, seq AS add_seq, name, category, price, discount,
               1 AS is_available
        FROM f WHERE reason IS NULL),
t1 AS (SELECT menu_id, name, category, price, discount, is_available FROM menu_items
       UNION ALL
       SELECT menu_id, name, category, price, discount, is_available FROM acc),
ups AS (SELECT * FROM (SELECT u.seq, u.menu_id, u.price, u.discount,
                              coalesce(u.is_available, 0) AS is_available,
                              row_number() OVER (PARTITION BY u.menu_id ORDER BY u.seq DESC)
                                AS rn
                       FROM menu_changes u LEFT JOIN acc x ON x.menu_id = u.menu_id
                       WHERE u.op = 'update' AND coalesce(u.price > 0, false)
                         AND coalesce(u.discount >= 0 AND u.discount <= 100, false)
                         AND (x.add_seq IS NULL OR u.seq > x.add_seq)) WHERE rn = 1),
t2 AS (SELECT t.menu_id, t.name, t.category,
              CASE WHEN u.menu_id IS NULL THEN t.price ELSE u.price END AS price,
              CASE WHEN u.menu_id IS NULL THEN t.discount ELSE u.discount END AS discount,
              CASE WHEN u.menu_id IS NULL THEN t.is_available ELSE u.is_available END
                AS is_available
       FROM t1 t LEFT JOIN ups u ON u.menu_id = t.menu_id),
new_del AS (SELECT d.menu_id FROM menu_changes d JOIN acc x ON x.menu_id = d.menu_id
            WHERE d.op = 'delete' AND d.seq > x.add_seq
              AND d.menu_id NOT IN (SELECT menu_id FROM menu_items)),
gone AS (SELECT menu_id FROM pre_del UNION SELECT menu_id FROM new_del)""")
def _apply_menu_changes(t):
    menu, _, _ = U.apply_menu_changes(t.menu_items, t.recipes, t.order_items, t.menu_changes)
    return menu


# ------------------------------------------------------------------ U6 / U7 / W3

@register("order_status_update", f"""
SELECT {_ORDER_OUT}
FROM orders o LEFT JOIN l ON o.order_id = l.order_id""", extra_ctes=f""",
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY seq DESC) AS rn
                     FROM status_changes WHERE actor = 'staff' AND status IN {_VALID})
      WHERE rn = 1)""")
def _order_status_update(t):
    return U.order_status_update(t.orders, t.status_changes)


_CANCEL_CTES = f""",
st AS (SELECT order_id, seq, status FROM status_changes
       WHERE actor = 'staff' AND status IN {_VALID}),
cc AS (SELECT seq, order_id, customer_id, status AS req FROM status_changes
       WHERE actor = 'customer'),
valid AS (SELECT cc.* FROM cc JOIN orders o ON o.order_id = cc.order_id
          WHERE cc.req = 'Cancelled' AND cc.customer_id = o.customer_id),
seg AS (SELECT v.*, (SELECT max(s.seq) FROM st s WHERE s.order_id = v.order_id AND s.seq < v.seq)
                      AS sseq
        FROM valid v),
based AS (SELECT g.*, coalesce((SELECT s.status FROM st s
                                WHERE s.order_id = g.order_id AND s.seq = g.sseq),
                               (SELECT o.status FROM orders o WHERE o.order_id = g.order_id))
                        AS base
          FROM seg g),
firsts AS (SELECT order_id, coalesce(sseq, -1) AS sk, min(seq) AS fseq FROM based GROUP BY 1, 2),
ok AS (SELECT b.order_id, b.seq FROM based b
       JOIN firsts f ON f.order_id = b.order_id AND f.sk = coalesce(b.sseq, -1) AND f.fseq = b.seq
       WHERE b.base = 'Pending')"""


@register("order_cancel", """
SELECT cc.seq, cc.order_id, cc.customer_id, (ok.seq IS NOT NULL) AS changed
FROM cc LEFT JOIN ok ON ok.order_id = cc.order_id AND ok.seq = cc.seq""",
          extra_ctes=_CANCEL_CTES)
def _order_cancel(t):
    return W.cancel_outcomes(t.orders, t.status_changes).select(
        "seq", "order_id", "customer_id", "changed")


@register("status_fold", f"""
SELECT {_ORDER_OUT}, CAST(coalesce(na.n, 0) AS BIGINT) AS cancel_applied
FROM orders o LEFT JOIN l ON o.order_id = l.order_id LEFT JOIN na ON o.order_id = na.order_id""",
          extra_ctes=_CANCEL_CTES + """,
ev AS (SELECT order_id, seq, status FROM st UNION ALL SELECT order_id, seq, 'Cancelled' FROM ok),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY seq DESC) AS rn
                     FROM ev) WHERE rn = 1),
na AS (SELECT order_id, count(*) AS n FROM ok GROUP BY 1)""")
def _status_fold(t):
    return W.status_fold(t.orders, t.status_changes)


# ------------------------------------------------------------------ U8

@register("cart_merge", """
SELECT f.cart_id, f.menu_id,
       CAST(coalesce((SELECT e.qty FROM e WHERE e.cart_id = s.cart_id AND e.menu_id = s.menu_id
                                        AND e.seq = s.s), 0)
            + coalesce((SELECT sum(greatest(1, coalesce(e.qty, 0))) FROM e
                        WHERE e.cart_id = f.cart_id AND e.menu_id = f.menu_id AND e.op = 'add'
                          AND e.av AND e.seq > coalesce(s.s, f.f - 1)), 0) AS INTEGER) AS qty
FROM f LEFT JOIN s ON s.cart_id = f.cart_id AND s.menu_id = f.menu_id""", extra_ctes=""",
e AS (SELECT ce.*, ce.menu_id IN (SELECT menu_id FROM menu_items WHERE is_available = 1) AS av
      FROM cart_events ce),
k AS (SELECT cart_id, menu_id,
             max(CASE WHEN op = 'remove' OR (op = 'set' AND coalesce(qty, 0) <= 0) THEN seq END)
               AS r
      FROM e GROUP BY 1, 2),
f AS (SELECT e.cart_id, e.menu_id, min(e.seq) AS f FROM e
      JOIN k ON k.cart_id = e.cart_id AND k.menu_id = e.menu_id
      WHERE e.op = 'add' AND e.av AND e.seq > coalesce(k.r, -4611686018427387904)
      GROUP BY 1, 2),
s AS (SELECT e.cart_id, e.menu_id, max(e.seq) AS s FROM e
      JOIN f ON f.cart_id = e.cart_id AND f.menu_id = e.menu_id
      WHERE e.op = 'set' AND e.qty > 0 AND e.seq > f.f GROUP BY 1, 2)""")
def _cart_merge(t):
    return U.cart_merge(t.cart_events, t.menu_items)


# ------------------------------------------------------------------ U9-U11

@register("delete_cascade", """
SELECT user_id, username, password, role, customer_id FROM users
WHERE customer_id IS NULL OR customer_id NOT IN (SELECT customer_id FROM customer_deletes)""")
def _delete_cascade(t):
    _, users, _ = U.delete_customers(t.customers, t.users, t.orders, t.customer_deletes)
    return users


@register("delete_set_null", """
SELECT ingredient_id, name,
       CASE WHEN supplier_id IN (SELECT supplier_id FROM gone) THEN NULL ELSE supplier_id END
         AS supplier_id
FROM ingredients""", extra_ctes=""",
gone AS (SELECT supplier_id FROM supplier_deletes
         WHERE supplier_id IN (SELECT supplier_id FROM suppliers)
           AND supplier_id NOT IN (SELECT supplier_id FROM purchases))""")
def _delete_set_null(t):
    _, ing, _ = U.delete_suppliers(t.suppliers, t.ingredients, t.purchases, t.supplier_deletes)
    return ing.select("ingredient_id", "name", "supplier_id")


@register("delete_restrict", """
SELECT supplier_id,
       CASE WHEN supplier_id NOT IN (SELECT supplier_id FROM suppliers) THEN 'not found'
            WHEN supplier_id IN (SELECT supplier_id FROM purchases)
              THEN 'refused: referenced by purchases'
            ELSE 'deleted' END AS outcome
FROM supplier_deletes""")
def _delete_restrict(t):
    _, _, out = U.delete_suppliers(t.suppliers, t.ingredients, t.purchases, t.supplier_deletes)
    return out


@register("delete_cascade_order_items", f"""
SELECT order_item_id, order_id, menu_id, quantity, CAST(price {D} AS price FROM order_items
WHERE order_id NOT IN (SELECT order_id FROM order_deletes)""")
def _delete_cascade_order_items(t):
    return U.delete_orders(t.orders, t.order_items, t.order_deletes)[1]


@register("delete_set_null_orders", f"""
SELECT order_id, CASE WHEN customer_id IN (SELECT customer_id FROM customer_deletes) THEN NULL
                      ELSE customer_id END AS customer_id, CAST(total_amount {D} AS total_amount
FROM orders""")
def _delete_set_null_orders(t):
    _, _, orders = U.delete_customers(t.customers, t.users, t.orders, t.customer_deletes)
    return orders.select("order_id", "customer_id", "total_amount")


@register("delete_restrict_employees", """
SELECT employee_id,
       CASE WHEN employee_id NOT IN (SELECT employee_id FROM employees) THEN 'not found'
            WHEN employee_id IN (SELECT employee_id FROM orders) THEN 'refused: referenced by orders'
            ELSE 'deleted' END AS outcome
FROM employee_deletes""")
def _delete_restrict_employees(t):
    return U.delete_employees(t.employees, t.orders, t.employee_deletes)[1]


@register("delete_restrict_ingredients", """
SELECT ingredient_id,
       CASE WHEN ingredient_id NOT IN (SELECT ingredient_id FROM ingredients) THEN 'not found'
            WHEN ingredient_id IN (SELECT ingredient_id FROM purchases)
              THEN 'refused: used by purchases'
            WHEN ingredient_id IN (SELECT ingredient_id FROM recipes) THEN 'refused: used by recipes'
            ELSE 'deleted' END AS outcome
FROM ingredient_deletes""")
def _delete_restrict_ingredients(t):
    return U.delete_requests(t.ingredients, "ingredient_id", t.ingredient_deletes,
                             [(t.purchases, "ingredient_id", "used by purchases"),
                              (t.recipes, "ingredient_id", "used by recipes")])


@register("menu_delete_recipes", f"""
SELECT menu_id, ingredient_id, CAST(qty_required {D} AS qty_required FROM recipes
WHERE menu_id NOT IN (SELECT menu_id FROM menu_changes WHERE op = 'delete')
   OR menu_id IN (SELECT menu_id FROM order_items)""")
def _menu_delete_recipes(t):
    req = t.menu_changes.filter(F.col("op") == "delete").select("seq", "menu_id")
    return U.menu_delete(t.menu_items, t.recipes, t.order_items, req)[1]


@register("menu_delete_where", f"""
SELECT 'sold' AS statement, menu_id, name FROM menu_items
WHERE (SELECT count(*) FROM order_items WHERE menu_id IN
         (SELECT menu_id FROM menu_items WHERE category = 'PROMO')) > 0 OR category <> 'PROMO'
UNION ALL
SELECT 'unsold', menu_id, name FROM menu_items
WHERE (SELECT count(*) FROM order_items WHERE menu_id IN
         (SELECT menu_id FROM menu_items WHERE price < 0 OR menu_id % 29 = 3 AND menu_id NOT IN
            (SELECT menu_id FROM order_items))) > 0
   OR NOT (menu_id % 29 = 3 AND menu_id NOT IN (SELECT menu_id FROM order_items))""")
def _menu_delete_where(t):
    """Q5 twice: a statement that hits sold items changes nothing; one that hits
    only unsold items deletes them."""
    sold, _, _ = U.menu_delete_where(t.menu_items, t.recipes, t.order_items,
                                     F.col("category") == "PROMO")
    unsold_ids = t.menu_items.join(t.order_items.select("menu_id").distinct(), "menu_id", "left_anti") \
        .filter(F.col("menu_id") % 29 == 3).select("menu_id", F.lit(True).alias("_hit"))
    marked = t.menu_items.join(unsold_ids, "menu_id", "left")
    unsold, _, _ = U.menu_delete_where(marked, t.recipes, t.order_items,
                                       F.coalesce("_hit", F.lit(False)))
    return sold.select(F.lit("sold").alias("statement"), "menu_id", "name").unionByName(
        unsold.select(F.lit("unsold").alias("statement"), "menu_id", "name"))


# ------------------------------------------------------------------ W1, W2

@register("stock_ledger", f"""
SELECT r.ingredient_id, r.ts, r.kind, r.ref, CAST(r.delta {D} AS delta,
       CAST(coalesce(i.quantity, 0) + r.moved - r.delta {D} AS before,
       CAST(coalesce(i.quantity, 0) + r.moved {D} AS after
FROM run r LEFT JOIN ingredients i ON i.ingredient_id = r.ingredient_id""", extra_ctes=""",
buys AS (SELECT ingredient_id, CAST(purchase_date AS TIMESTAMP) AS ts, 0 AS kind,
                purchase_id AS ref, CAST(quantity AS DECIMAL(20,2)) AS delta FROM purchases),
used AS (SELECT oi.order_id, r.ingredient_id, sum(r.qty_required * oi.quantity) AS used
         FROM order_items oi JOIN recipes r ON r.menu_id = oi.menu_id GROUP BY 1, 2),
sales AS (SELECT u.ingredient_id, o.order_date AS ts, 1 AS kind, u.order_id AS ref,
                 CAST(-u.used AS DECIMAL(20,2)) AS delta
          FROM used u JOIN orders o ON o.order_id = u.order_id),
mv AS (SELECT * FROM buys UNION ALL SELECT * FROM sales),
run AS (SELECT *, sum(delta) OVER (PARTITION BY ingredient_id ORDER BY ts, kind, ref
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS moved
        FROM mv)""")
def _stock_ledger(t):
    moves = W.movements(t.purchases, t.order_items, t.orders, t.recipes)
    return W.stock_ledger(t.ingredients, moves, counts=W.most_movements(t.purchases, t.order_items, t.recipes))


@register("assign_ids", """
SELECT purchase_id, row_number() OVER (ORDER BY purchase_date, purchase_id) AS id
FROM purchases""")
def _assign_ids(t):
    return W.assign_ids(t.purchases.select("purchase_id", "purchase_date"),
                        ["purchase_date", "purchase_id"]).select("purchase_id", "id")


# ------------------------------------------------------------------ the graph of foreign keys

_GRAPH = (("customers", "customer_id % 9 = 4"), ("orders", "order_id % 11 = 5"), ("suppliers", "supplier_id % 2 = 0"),
          ("menu_items", "menu_id < 0"))


def _state(statement: str, table: str, refs: str, frame: str) -> str:
    """Rows, and NULLs in a reference column, of a table after a statement."""
    return (f"SELECT '{statement}' AS statement, '{table}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, "
            f"CAST(count(*) - count({refs}) AS BIGINT) AS n_nulls FROM {frame}")


@register("delete_graph", "\nUNION ALL\n".join([
    _state("customers", "customers", "customer_id", "(SELECT * FROM customers WHERE NOT customer_id % 9 = 4)"),
    _state("customers", "users", "customer_id",
           "(SELECT * FROM users WHERE customer_id IS NULL OR NOT (customer_id % 9 = 4 AND customer_id IN (SELECT customer_id FROM customers)))"),
    _state("customers", "orders", "customer_id",
           "(SELECT CASE WHEN customer_id % 9 = 4 AND customer_id IN (SELECT customer_id FROM customers) THEN NULL "
           "ELSE customer_id END AS customer_id FROM orders)"),
    _state("orders", "orders", "order_id", "(SELECT * FROM orders WHERE NOT order_id % 11 = 5)"),
    _state("orders", "order_items", "order_id",
           "(SELECT * FROM order_items WHERE NOT (order_id % 11 = 5 AND order_id IN (SELECT order_id FROM orders)))"),
    # refused if a purchase names one of the suppliers; then nothing changes
    _state("suppliers", "suppliers", "supplier_id",
           "(SELECT * FROM suppliers WHERE NOT supplier_id % 2 = 0 OR EXISTS (SELECT 1 FROM purchases WHERE supplier_id % 2 = 0 "
           "AND supplier_id IN (SELECT supplier_id FROM suppliers)))"),
    _state("suppliers", "ingredients", "supplier_id",
           "(SELECT CASE WHEN supplier_id % 2 = 0 AND supplier_id IN (SELECT supplier_id FROM suppliers) AND NOT EXISTS "
           "(SELECT 1 FROM purchases p WHERE p.supplier_id % 2 = 0 AND p.supplier_id IN (SELECT supplier_id FROM suppliers)) "
           "THEN NULL ELSE supplier_id END AS supplier_id FROM ingredients)"),
    _state("menu_items", "menu_items", "menu_id", "menu_items"),
    _state("menu_items", "recipes", "menu_id", "recipes")]))
def _delete_graph(t):
    """Four delete statements, each on the tables as they are; the state of every table that it touches."""
    tables = {n: getattr(t, n) for n in SCHEMAS}
    refs = {"customers": "customer_id", "users": "customer_id", "suppliers": "supplier_id",
            "ingredients": "supplier_id", "menu_items": "menu_id", "recipes": "menu_id", "order_items": "order_id"}
    parts = []
    for table, condition in _GRAPH:
        for name, df in R.delete_where(tables, table, condition).tables.items():
            ref = "order_id" if name == "orders" and table == "orders" else refs.get(name, "customer_id")
            parts.append(df.agg(F.lit(table).alias("statement"), F.lit(name).alias("table_name"),
                                F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(ref).isNull()).alias("n_nulls")))
    return reduce(lambda a, b: a.unionByName(b), parts)
