"""Registered report queries: sources, filters, joins, aggregates, sorts.

Each job runs over the whole stand-in tables; parameters (a search text, a
status, a HAVING threshold) are the features' own inputs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import exprs as X
from larder.operators import aggregates as A
from larder.operators import filters as P
from larder.operators import joins as J
from larder.plans.registry import register
from larder.sources import catalog

D = "AS DOUBLE)"  # shorthand used in the oracle text: CAST(x AS DOUBLE)

# ---------------------------------------------------------------- sources / views


@register("scan_all", f"""
SELECT menu_id, name, category, CAST(price {D} AS price, CAST(discount {D} AS discount,
       is_available FROM menu_items""")
def _scan_all(t):
    return P.scan_all(t.menu_items)


@register("view_low_stock", f"""
SELECT i.name, CAST(i.quantity {D} AS quantity, i.unit, CAST(i.reorder_level {D} AS reorder_level,
       s.name AS supplier
FROM ingredients i LEFT JOIN suppliers s ON i.supplier_id = s.supplier_id
WHERE i.quantity <= i.reorder_level""")
def _view_low_stock(t):
    catalog.register_views(t.spark, {"ingredients": t.ingredients, "suppliers": t.suppliers,
                                     "orders": t.orders})
    return t.spark.table("v_low_stock")


@register("view_daily_sales", f"""
SELECT CAST(CAST(order_date AS DATE) AS TIMESTAMP) AS day, count(*) AS total_orders,
       CAST(sum(total_amount) {D} AS total_sales
FROM orders WHERE status = 'Paid' GROUP BY 1""")
def _view_daily_sales(t):
    catalog.register_views(t.spark, {"ingredients": t.ingredients, "suppliers": t.suppliers,
                                     "orders": t.orders})
    return t.spark.table("v_daily_sales")


# ---------------------------------------------------------------- projections / filters

@register("project_cols", f"""
SELECT name AS ingredient, CAST(quantity {D} AS quantity, unit FROM ingredients""")
def _project_cols(t):
    return P.project_cols(t.ingredients, {"name": "ingredient", "quantity": "quantity",
                                          "unit": "unit"})


@register("filter_and_eq", f"""
SELECT menu_id, name, CAST(price {D} AS price FROM menu_items
WHERE category = 'PROMO' AND is_available = 1""")
def _filter_and_eq(t):
    return P.filter_and_eq(t.menu_items, "PROMO")


_FINAL = "CAST(round(price - price * discount * 0.01, 2) AS DOUBLE)"
_SAVE = "CAST(round(price * discount * 0.01, 2) AS DOUBLE)"


@register("final_price", f"""
SELECT menu_id, name, CAST(price {D} AS price, CAST(discount {D} AS discount,
       {_FINAL} AS final_price
FROM menu_items WHERE is_available = 1""")
def _final_price(t):
    return P.final_price_list(t.menu_items)


@register("discounted_items", f"""
SELECT menu_id, name, category, CAST(price {D} AS price, CAST(discount {D} AS discount,
       {_FINAL} AS final_price, {_SAVE} AS you_save
FROM menu_items WHERE discount > 0""")
def _discounted_items(t):
    return P.discounted_items(t.menu_items)


@register("menu_listing", f"""
SELECT menu_id, name, category, CAST(price {D} AS price, CAST(discount {D} AS discount,
       {_FINAL} AS final_price
FROM menu_items WHERE is_available = 1""")
def _menu_listing(t):
    return P.menu_listing(t.menu_items)


@register("low_stock", f"""
SELECT ingredient_id, name, CAST(quantity {D} AS quantity, unit,
       CAST(reorder_level {D} AS reorder_level
FROM ingredients WHERE quantity <= reorder_level""")
def _low_stock(t):
    return P.low_stock(t.ingredients)


@register("stock_value", f"""
SELECT ingredient_id, name, CAST(quantity {D} AS quantity, CAST(unit_price {D} AS unit_price,
       CAST(quantity * unit_price {D} AS stock_value
FROM ingredients""")
def _stock_value(t):
    return P.stock_value(t.ingredients)


@register("line_subtotal", f"""
SELECT order_item_id, order_id, menu_id, quantity, CAST(price {D} AS price,
       CAST(quantity * price {D} AS subtotal
FROM order_items""")
def _line_subtotal(t):
    return P.line_subtotal(t.order_items)


@register("name_search", """
SELECT ingredient_id, name FROM ingredients WHERE name ILIKE '%ring%'""")
def _name_search(t):
    i = t.ingredients
    return i.filter(P.name_search(i, "ring")).select("ingredient_id", "name")


_INVENTORY = f"""
SELECT i.ingredient_id, i.name, i.unit, CAST(i.quantity {D} AS quantity,
       CAST(i.reorder_level {D} AS reorder_level, CAST(i.unit_price {D} AS unit_price,
       CAST(i.quantity * i.unit_price {D} AS stock_value, s.name AS supplier
FROM ingredients i LEFT JOIN suppliers s ON i.supplier_id = s.supplier_id"""


@register("stock_status_filter", _INVENTORY + """
WHERE i.name ILIKE '%ring%' AND i.quantity > i.reorder_level""")
def _stock_status_filter(t):
    return J.inventory_list(t.ingredients, t.suppliers,
                            P.stock_status_condition("  ring ", "in_stock"))


_ORDER_COLS = f"""order_id, customer_id, employee_id, order_date, status,
       CAST(total_amount {D} AS total_amount"""


@register("order_status_filter", f"""
SELECT {_ORDER_COLS} FROM orders WHERE status = 'Pending'""")
def _order_status_filter(t):
    return P.order_status_filter(t.orders, "Pending")


@register("in_list", f"""
SELECT order_id, status, CAST(total_amount {D} AS total_amount FROM orders
WHERE status IN ('Served', 'Cancelled')""")
def _in_list(t):
    return P.in_list(t.orders, "status", ["Served", "Cancelled"]).select(
        "order_id", "status", "total_amount")


@register("key_param_filter", f"""
SELECT order_item_id, order_id, menu_id, quantity, CAST(price {D} AS price FROM order_items
WHERE order_id IN (SELECT order_id FROM orders WHERE status = 'Pending')""")
def _key_param_filter(t):
    keys = t.orders.filter(F.col("status") == "Pending").select("order_id")
    return P.key_param_filter(t.order_items, "order_id", keys).select(
        "order_item_id", "order_id", "menu_id", "quantity", "price")


@register("scalar_subquery", f"""
SELECT menu_id, name, CAST(price {D} AS price FROM menu_items
WHERE price > (SELECT avg(price) FROM menu_items)""")
def _scalar_subquery(t):
    return P.scalar_subquery(t.menu_items)


@register("in_subquery", """
SELECT ingredient_id, name FROM ingredients
WHERE ingredient_id IN (SELECT ingredient_id FROM recipes
                        WHERE menu_id IN (SELECT menu_id FROM menu_items
                                          WHERE category = 'PROMO'))""")
def _in_subquery(t):
    keys = t.menu_items.filter(F.col("category") == "PROMO")
    return P.in_subquery(t.ingredients, t.recipes, keys).select("ingredient_id", "name")


@register("correlated_scalar", f"""
SELECT oi.order_item_id, oi.order_id, oi.menu_id, r.ingredient_id,
       CAST(r.qty_required * oi.quantity {D} AS used
FROM order_items oi JOIN recipes r ON r.menu_id = oi.menu_id""")
def _correlated_scalar(t):
    return P.correlated_scalar(t.order_items, t.recipes)


# ---------------------------------------------------------------- joins

@register("join_inner", f"""
SELECT i.name AS ingredient, CAST(i.quantity {D} AS quantity, i.unit, s.name AS supplier
FROM ingredients i JOIN suppliers s ON i.supplier_id = s.supplier_id""")
def _join_inner(t):
    return J.join_inner(t.ingredients, t.suppliers)


@register("join_left_count", """
SELECT c.customer_id, c.name, CAST(count(o.order_id) AS BIGINT) AS total_orders
FROM customers c LEFT JOIN orders o ON c.customer_id = o.customer_id
GROUP BY c.customer_id, c.name""")
def _join_left_count(t):
    return J.join_left_count(t.customers, t.orders)


_BILL = f"""m.name AS item, oi.quantity, CAST(oi.price {D} AS price,
       CAST(oi.quantity * oi.price {D} AS subtotal"""


@register("order_bill_4way", f"""
SELECT o.order_id, c.name AS customer, {_BILL}
FROM orders o JOIN customers c ON o.customer_id = c.customer_id
JOIN order_items oi ON o.order_id = oi.order_id
JOIN menu_items m ON oi.menu_id = m.menu_id""")
def _order_bill_4way(t):
    return J.order_bill_4way(t.orders, t.customers, t.order_items, t.menu_items)


@register("order_bill_lines", f"""
SELECT oi.order_id, {_BILL.replace('m.name AS item', 'm.name')}
FROM order_items oi JOIN menu_items m ON oi.menu_id = m.menu_id""")
def _order_bill_lines(t):
    return J.order_bill_lines(t.order_items, t.menu_items)


@register("owner_bill", f"""
SELECT o.customer_id, oi.order_id, {_BILL.replace('m.name AS item', 'm.name')}
FROM order_items oi JOIN menu_items m ON oi.menu_id = m.menu_id
JOIN orders o ON o.order_id = oi.order_id
WHERE (o.order_id, o.customer_id) IN (SELECT order_id, customer_id FROM bill_requests)""")
def _owner_bill(t):
    return J.owner_bill(t.order_items, t.menu_items, t.orders, t.bill_requests)


@register("inventory_list", _INVENTORY)
def _inventory_list(t):
    return J.inventory_list(t.ingredients, t.suppliers)


@register("low_stock_supplier", f"""
SELECT i.name, CAST(i.quantity {D} AS quantity, i.unit, CAST(i.reorder_level {D} AS reorder_level,
       s.name AS supplier
FROM ingredients i LEFT JOIN suppliers s ON i.supplier_id = s.supplier_id
WHERE i.quantity <= i.reorder_level""")
def _low_stock_supplier(t):
    return J.low_stock_supplier(t.ingredients, t.suppliers)


@register("recent_orders", f"""
SELECT o.order_id, coalesce(c.name, 'Walk-in') AS customer, e.name AS staff, o.order_date,
       o.status, CAST(o.total_amount {D} AS total_amount
FROM orders o LEFT JOIN customers c ON o.customer_id = c.customer_id
JOIN employees e ON o.employee_id = e.employee_id
ORDER BY o.order_id DESC LIMIT 6""")
def _recent_orders(t):
    return J.recent_orders(t.orders, t.customers, t.employees, 6)


@register("order_listing", f"""
SELECT o.order_id, coalesce(c.name, 'Walk-in') AS customer, e.name AS staff, o.order_date,
       o.status, CAST(o.total_amount {D} AS total_amount,
       CAST(count(oi.order_item_id) AS BIGINT) AS items
FROM orders o LEFT JOIN customers c ON o.customer_id = c.customer_id
JOIN employees e ON o.employee_id = e.employee_id
LEFT JOIN order_items oi ON o.order_id = oi.order_id
GROUP BY o.order_id, c.name, e.name, o.order_date, o.status, o.total_amount""")
def _order_listing(t):
    return J.order_listing(t.orders, t.customers, t.employees, t.order_items)


@register("purchase_history", f"""
SELECT p.purchase_id, s.name AS supplier, i.name AS ingredient, CAST(p.quantity {D} AS quantity,
       i.unit, CAST(p.cost {D} AS cost, CAST(p.purchase_date AS TIMESTAMP) AS purchase_date
FROM purchases p JOIN suppliers s ON p.supplier_id = s.supplier_id
JOIN ingredients i ON p.ingredient_id = i.ingredient_id
ORDER BY p.purchase_id DESC, supplier, ingredient, p.quantity, p.cost, p.purchase_date
LIMIT 15""")
def _purchase_history(t):
    return J.purchase_history(t.purchases, t.suppliers, t.ingredients, 15)


@register("recipe_report", f"""
SELECT m.name AS food, i.name AS ingredient, CAST(r.qty_required {D} AS qty_required, i.unit
FROM recipes r JOIN menu_items m ON r.menu_id = m.menu_id
JOIN ingredients i ON r.ingredient_id = i.ingredient_id""")
def _recipe_report(t):
    return J.recipe_report(t.recipes, t.menu_items, t.ingredients)


@register("account_directory", """
SELECT u.user_id, u.username, u.role, u.customer_id, c.name AS customer_name,
       coalesce(nullif(c.name, ''), u.username) AS display_name
FROM users u LEFT JOIN customers c ON u.customer_id = c.customer_id""")
def _account_directory(t):
    return J.account_directory(t.users, t.customers)


@register("login_audit", """
SELECT a.seq, trim(a.username) AS username,
       coalesce(u.password = sha256(a.password), false) AS ok,
       CASE WHEN coalesce(u.password = sha256(a.password), false) THEN u.role END AS role,
       CASE WHEN coalesce(u.password = sha256(a.password), false) THEN u.customer_id END
         AS customer_id
FROM login_attempts a LEFT JOIN users u ON u.username = trim(a.username)""")
def _login_audit(t):
    return J.login_audit(t.login_attempts, t.users)


@register("join_semi", """
SELECT menu_id, name FROM menu_items
WHERE menu_id IN (SELECT menu_id FROM order_items)""")
def _join_semi(t):
    return J.join_semi(t.menu_items, t.order_items, "menu_id").select("menu_id", "name")


@register("join_anti", """
SELECT ingredient_id, supplier_id FROM ingredients i
WHERE supplier_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM suppliers s WHERE s.supplier_id = i.supplier_id)""")
def _join_anti(t):
    return J.join_anti(t.ingredients, t.suppliers, "supplier_id").select(
        "ingredient_id", "supplier_id")


# ---------------------------------------------------------------- aggregates

@register("count_rows", """
SELECT CAST(count(*) AS BIGINT) AS n FROM orders""")
def _count_rows(t):
    return A.count_rows(t.orders)


@register("count_col", """
SELECT CAST(count(customer_id) AS BIGINT) AS n FROM orders""")
def _count_col(t):
    return A.count_col(t.orders, "customer_id")


@register("sum_or_zero", f"""
SELECT CAST(coalesce(sum(total_amount), 0) {D} AS total FROM orders WHERE status = 'Paid'""")
def _sum_or_zero(t):
    return A.sum_or_zero(t.orders, "total_amount", F.col("status") == "Paid")


@register("dashboard_kpis", f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM menu_items) AS total_food,
       (SELECT CAST(count(*) AS BIGINT) FROM menu_items WHERE discount > 0) AS offer_count,
       (SELECT CAST(count(*) AS BIGINT) FROM orders) AS total_orders,
       (SELECT CAST(coalesce(sum(total_amount), 0) {D} FROM orders WHERE status = 'Paid')
         AS total_sales,
       (SELECT CAST(coalesce(sum(quantity * unit_price), 0) {D} FROM ingredients) AS stock_value,
       (SELECT CAST(count(*) AS BIGINT) FROM ingredients WHERE quantity <= reorder_level)
         AS low_count""")
def _dashboard_kpis(t):
    return A.dashboard_kpis(t.menu_items, t.orders, t.ingredients)


@register("daily_sales", f"""
SELECT CAST(CAST(order_date AS DATE) AS TIMESTAMP) AS day, count(*) AS total_orders,
       CAST(sum(total_amount) {D} AS total_sales
FROM orders WHERE status = 'Paid' GROUP BY 1""")
def _daily_sales(t):
    return A.daily_sales(t.orders)


@register("best_sellers", """
SELECT m.menu_id, m.name, CAST(sum(oi.quantity) AS BIGINT) AS sold
FROM order_items oi JOIN menu_items m ON oi.menu_id = m.menu_id
GROUP BY m.menu_id, m.name""")
def _best_sellers(t):
    return A.best_sellers(t.order_items, t.menu_items)


@register("best_sellers_revenue", f"""
SELECT m.name, CAST(sum(oi.quantity) AS BIGINT) AS sold,
       CAST(sum(oi.quantity * oi.price) {D} AS revenue
FROM order_items oi JOIN menu_items m ON oi.menu_id = m.menu_id
GROUP BY m.name""")
def _best_sellers_revenue(t):
    return A.best_sellers_revenue(t.order_items, t.menu_items)


@register("supplier_cost_having", f"""
SELECT s.supplier_id, s.name, CAST(sum(p.cost) {D} AS total_cost
FROM suppliers s JOIN purchases p ON s.supplier_id = p.supplier_id
GROUP BY s.supplier_id, s.name HAVING sum(p.cost) > 10500000""")
def _supplier_cost_having(t):
    return A.supplier_cost_having(t.suppliers, t.purchases, 10500000)


@register("employee_sales", f"""
SELECT e.employee_id, e.name, e.role, CAST(count(o.order_id) AS BIGINT) AS orders_handled,
       CAST(coalesce(sum(o.total_amount), 0) {D} AS sales
FROM employees e LEFT JOIN orders o ON e.employee_id = o.employee_id
GROUP BY e.employee_id, e.name, e.role""")
def _employee_sales(t):
    return A.employee_sales(t.employees, t.orders)


@register("customer_spend", f"""
SELECT c.name, CAST(count(o.order_id) AS BIGINT) AS orders,
       CAST(coalesce(sum(o.total_amount), 0) {D} AS total_spent
FROM customers c LEFT JOIN orders o ON c.customer_id = o.customer_id
GROUP BY c.name HAVING coalesce(sum(o.total_amount), 0) > 0""")
def _customer_spend(t):
    return A.customer_spend(t.customers, t.orders)


@register("supplier_purchases", f"""
SELECT s.name AS supplier, CAST(count(p.purchase_id) AS BIGINT) AS purchases,
       CAST(coalesce(sum(p.cost), 0) {D} AS total_cost
FROM suppliers s LEFT JOIN purchases p ON s.supplier_id = p.supplier_id
GROUP BY s.name""")
def _supplier_purchases(t):
    return A.supplier_purchases(t.suppliers, t.purchases)


@register("stock_totals", f"""
SELECT CAST(count(*) AS BIGINT) AS items,
       CAST(round(sum(quantity * unit_price), 2) {D} AS stock_value,
       round(avg(CAST(unit_price AS DECIMAL(18,2))), 2) AS avg_unit_price
FROM ingredients""")
def _stock_totals(t):
    return A.stock_totals(t.ingredients)


@register("my_orders", f"""
SELECT o.customer_id, o.order_id, o.order_date, o.status,
       CAST(o.total_amount {D} AS total_amount, CAST(count(oi.order_item_id) AS BIGINT) AS items
FROM orders o LEFT JOIN order_items oi ON o.order_id = oi.order_id
WHERE o.customer_id IS NOT NULL
GROUP BY o.customer_id, o.order_id, o.order_date, o.status, o.total_amount""")
def _my_orders(t):
    return A.my_orders(t.orders, t.order_items)


@register("menu_by_category", f"""
SELECT category, row_number() OVER (PARTITION BY category ORDER BY name, menu_id) AS position,
       name, menu_id, CAST(price {D} AS price, CAST(discount {D} AS discount,
       {_FINAL} AS final_price
FROM menu_items WHERE is_available = 1""")
def _menu_by_category(t):
    return A.menu_by_category(t.menu_items)


@register("bill_with_total", f"""
SELECT oi.order_id, m.name, oi.quantity, CAST(oi.price {D} AS price,
       CAST(oi.quantity * oi.price {D} AS subtotal, 'line' AS row_kind
FROM order_items oi JOIN menu_items m ON oi.menu_id = m.menu_id
UNION ALL
SELECT order_id, NULL, NULL, NULL, CAST(sum(quantity * price) {D}, 'total'
FROM order_items GROUP BY order_id""")
def _bill_with_total(t):
    return A.bill_with_total(t.order_items, t.menu_items)


@register("cart_totals", f"""
SELECT l.cart_id,
       CAST(sum(round(m.price - m.price * m.discount * 0.01, 2) * l.qty) {D} AS grand,
       CAST(sum((m.price - round(m.price - m.price * m.discount * 0.01, 2)) * l.qty) {D} AS saved
FROM cart_lines l JOIN menu_items m ON l.menu_id = m.menu_id
GROUP BY l.cart_id""")
def _cart_totals(t):
    return A.cart_totals(t.carts, t.menu_items)


@register("cart_count", """
SELECT cart_id, CAST(sum(qty) AS BIGINT) AS cart_count FROM cart_lines GROUP BY cart_id""")
def _cart_count(t):
    return A.cart_count(t.carts)


@register("result_count", """
SELECT CAST(count(*) AS BIGINT) AS rows FROM menu_items WHERE is_available = 1""")
def _result_count(t):
    return A.result_count(P.menu_listing(t.menu_items))


@register("order_reconcile", f"""
SELECT o.order_id, CAST(o.total_amount {D} AS total_amount,
       CAST(coalesce(s.s, 0) {D} AS items_total,
       CAST(o.total_amount - coalesce(s.s, 0) {D} AS difference
FROM orders o LEFT JOIN (SELECT order_id, sum(quantity * price) AS s FROM order_items
                         GROUP BY order_id) s ON o.order_id = s.order_id""")
def _order_reconcile(t):
    return A.order_reconcile(t.orders, t.order_items)


# ---------------------------------------------------------------- sorts / top-k

@register("sort_asc_desc", f"""
SELECT menu_id, name, CAST(price {D} AS price FROM menu_items""")
def _sort_asc_desc(t):
    return P.sort_asc_desc(t.menu_items.select("menu_id", "name", "price"), "price", True,
                           "menu_id")


@register("sort_multi", f"""
SELECT category, name, menu_id, CAST(price {D} AS price FROM menu_items""")
def _sort_multi(t):
    return P.sort_multi(t.menu_items.select("category", "name", "menu_id", "price"),
                        "category", "name", "menu_id")


@register("sort_boolean", """
SELECT ingredient_id, name, CAST(quantity <= reorder_level AS BOOLEAN) AS low
FROM ingredients""")
def _sort_boolean(t):
    return P.sort_boolean(t.ingredients).select("ingredient_id", "name",
                                                X.is_low().alias("low"))


@register("topk", f"""
SELECT menu_id, name, CAST(price {D} AS price FROM menu_items
ORDER BY price DESC, menu_id LIMIT 10""")
def _topk(t):
    return P.topk(t.menu_items.select("menu_id", "name", "price"), 10,
                  F.col("price").desc(), F.col("menu_id"))


@register("first_waiter", """
SELECT employee_id, name, role FROM employees
ORDER BY CASE WHEN role = 'Waiter' THEN 0 ELSE 1 END, employee_id LIMIT 1""")
def _first_waiter(t):
    return P.first_waiter(t.employees)


# ---------------------------------------------------------------- scalar functions

@register("scalar_functions", f"""
SELECT menu_id,
       {_FINAL} AS final_price,
       {_SAVE} AS you_save,
       format('{{:,.2f}}', CAST(price AS DOUBLE)) AS price_text,
       regexp_replace(regexp_replace(CAST(discount AS VARCHAR), '0+$', ''), '\\.$', '')
         AS discount_text,
       lower(name) AS name_lower,
       trim('  ' || category || ' ') AS category_trim,
       sha256(name) AS name_hash,
       coalesce(nullif(name, ''), 'unnamed') AS label,
       CAST(greatest(1, is_available) AS INTEGER) AS min_one,
       coalesce(TRY_CAST(category AS DOUBLE), 0.0) AS category_number,
       'Stock raised: ' || name || ' ' || format('{{:,.2f}}', CAST(price AS DOUBLE)) || ' -> '
         || format('{{:,.2f}}', CAST(price * 2 AS DOUBLE)) AS message,
       price * 2 > 1000 AND discount >= 10 AS flag
FROM menu_items""")
def _scalar_functions(t):
    m = t.menu_items
    return m.select(
        "menu_id",
        X.final_price().alias("final_price"),
        X.you_save().alias("you_save"),
        X.money_text("price").alias("price_text"),
        X.percent_text("discount").alias("discount_text"),
        F.lower("name").alias("name_lower"),
        F.trim(F.concat(F.lit("  "), F.col("category"), F.lit(" "))).alias("category_trim"),
        X.password_hash("name").alias("name_hash"),
        X.name_or("name", F.lit("unnamed")).alias("label"),
        X.at_least_one("is_available").alias("min_one"),
        X.tolerant_number("category").alias("category_number"),
        X.purchase_message("name", F.col("price"), F.col("price") * 2).alias("message"),
        ((F.col("price") * 2 > 1000) & (F.col("discount") >= 10)).alias("flag"),
    )


# what a form may hold in a quantity field: numbers, blanks around them, words, nothing
_FORM_TEXT = """CASE menu_id % 6 WHEN 0 THEN CAST(price AS STRING) WHEN 1 THEN category
  WHEN 2 THEN concat('  ', CAST(menu_id AS STRING), ' ') WHEN 3 THEN concat('-', CAST(price AS STRING))
  WHEN 4 THEN '' END"""


@register("tolerant_int", f"""
SELECT menu_id, coalesce(CAST(trunc(TRY_CAST(typed AS DOUBLE)) AS BIGINT), 1) AS qty,
       coalesce(TRY_CAST(typed AS DOUBLE), 0.0) AS number
FROM (SELECT menu_id, {_FORM_TEXT} AS typed FROM menu_items)""")
def _tolerant_int(t):
    typed = t.menu_items.select("menu_id", F.expr(_FORM_TEXT).alias("typed"))
    return typed.select("menu_id", X.tolerant_int("typed", 1).alias("qty"), X.tolerant_number("typed").alias("number"))
