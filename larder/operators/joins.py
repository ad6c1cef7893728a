"""Joins (J1-J15).

Physical strategy: sides are joined without hints; AQE (enabled in ``build_session``) then turns a sort-merge
join into a broadcast-hash join from *runtime* sizes
(``spark.sql.adaptive.autoBroadcastJoinThreshold``), and splits skewed
partitions of the large side when a hot key holds many rows.  That is the
size check: nothing is broadcast on a guess, and above the threshold the
shuffle join is the fallback.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import exprs as X

def join_inner(ingredients: DataFrame, suppliers: DataFrame) -> DataFrame:
    """J1 (Q6): ingredient with its supplier name; supplier-less rows drop."""
    i, s = ingredients.alias("i"), suppliers.alias("s")
    return (i.join(s, F.col("i.supplier_id") == F.col("s.supplier_id"), "inner")
             .select(F.col("i.name").alias("ingredient"), F.col("i.quantity"), F.col("i.unit"),
                     F.col("s.name").alias("supplier")))


def join_left_count(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """J2 (Q7): every customer with COUNT(order) — 0 when none.

    Orders are counted per customer first (partial+final aggregation, one
    shuffle of small partials) and then left-joined, instead of joining every
    order row to its customer.
    """
    per = (orders.filter(F.col("customer_id").isNotNull())
                 .groupBy("customer_id").agg(F.count("order_id").alias("n")))
    return (customers.join(per, "customer_id", "left")
                     .select("customer_id", "name",
                             F.coalesce("n", F.lit(0)).cast("long").alias("total_orders")))


def order_bill_4way(orders: DataFrame, customers: DataFrame, order_items: DataFrame,
                    menu_items: DataFrame, order_ids: DataFrame | None = None) -> DataFrame:
    """J3 (Q8): bill lines with customer name (inner joins: walk-ins drop).

    ``order_ids`` (a one-column frame of order ids) restricts the bill to the
    requested orders through a semi join; None bills every order.
    """
    o = orders.select("order_id", "customer_id")
    if order_ids is not None:
        o = o.join(order_ids.select("order_id"), "order_id", "left_semi")
    c = customers.select("customer_id", F.col("name").alias("customer"))
    oi = order_items.select("order_id", "menu_id", "quantity", "price")
    m = menu_items.select("menu_id", F.col("name").alias("item"))
    return (o.join(c, "customer_id").join(oi, "order_id").join(m, "menu_id")
             .select("order_id", "customer", "item", "quantity", "price",
                     X.line_subtotal().alias("subtotal")))


def order_bill_lines(order_items: DataFrame, menu_items: DataFrame,
                     order_ids: DataFrame | None = None) -> DataFrame:
    """(order_id, name, quantity, price, subtotal) per bill line."""
    oi = order_items.select("order_id", "menu_id", "quantity", "price")
    if order_ids is not None:
        oi = oi.join(order_ids.select("order_id"), "order_id", "left_semi")
    m = menu_items.select("menu_id", "name")
    return (oi.join(m, "menu_id")
              .select("order_id", "name", "quantity", "price",
                      X.line_subtotal().alias("subtotal")))


def owner_bill(order_items: DataFrame, menu_items: DataFrame, orders: DataFrame,
               requests: DataFrame) -> DataFrame:
    """Bill lines a customer may see — requests (order_id, customer_id)
    only match orders the requesting customer owns."""
    owned = (orders.select("order_id", "customer_id")
                   .join(requests.select("order_id", "customer_id"),
                         ["order_id", "customer_id"], "left_semi"))
    lines = order_bill_lines(order_items, menu_items)
    return lines.join(owned, "order_id").select(
        "customer_id", "order_id", "name", "quantity", "price", "subtotal")


def inventory_list(ingredients: DataFrame, suppliers: DataFrame,
                   condition=None) -> DataFrame:
    """Ingredients with supplier (kept when missing) and stock value,
    low stock first then by name.  ``condition`` is an optional filter."""
    i = ingredients if condition is None else ingredients.filter(condition)
    s = suppliers.select("supplier_id", F.col("name").alias("supplier"))
    return (i.join(s, "supplier_id", "left")
             .select("ingredient_id", "name", "unit", "quantity", "reorder_level", "unit_price",
                     X.stock_value().alias("stock_value"), "supplier")
             .orderBy(X.is_low().desc(), "name", "ingredient_id"))


def low_stock_supplier(ingredients: DataFrame, suppliers: DataFrame) -> DataFrame:
    """J7 / view v_low_stock: low ingredients with supplier name (left join)."""
    s = suppliers.select("supplier_id", F.col("name").alias("supplier"))
    return (ingredients.filter(X.is_low())
            .join(s, "supplier_id", "left")
            .select("name", "quantity", "unit", "reorder_level", "supplier"))


def recent_orders(orders: DataFrame, customers: DataFrame, employees: DataFrame,
                  n: int = 6) -> DataFrame:
    """Latest ``n`` orders by id with customer ('Walk-in') and staff name.

    The inner join with staff can drop orders, so it is applied first as a
    semi join against the staff keys; then the top-k runs
    (TakeOrderedAndProject keeps n rows per task) and only n rows reach the
    remaining joins.
    """
    e = employees.select("employee_id", F.col("name").alias("staff"))
    top = (orders.join(e.select("employee_id"), "employee_id", "left_semi")
                 .orderBy(F.col("order_id").desc()).limit(n))
    c = customers.select("customer_id", F.col("name").alias("cname"))
    return (top.join(c, "customer_id", "left").join(e, "employee_id")
               .select("order_id", X.or_label("cname", "Walk-in").alias("customer"), "staff",
                       "order_date", "status", "total_amount")
               .orderBy(F.col("order_id").desc()))


def order_listing(orders: DataFrame, customers: DataFrame, employees: DataFrame,
                  order_items: DataFrame, status: str | None = None) -> DataFrame:
    """All orders with customer ('Walk-in'), staff and item count.

    Items are counted per order before the left join (one row per order
    leaves the aggregation) and the status filter is applied to orders before
    any join.
    """
    o = orders if status not in ("Pending", "Served", "Paid", "Cancelled") else \
        orders.filter(F.col("status") == status)
    items = order_items.groupBy("order_id").agg(F.count("menu_id").alias("items"))
    c = customers.select("customer_id", F.col("name").alias("cname"))
    e = employees.select("employee_id", F.col("name").alias("staff"))
    return (o.join(c, "customer_id", "left").join(e, "employee_id")
             .join(items, "order_id", "left")
             .select("order_id", X.or_label("cname", "Walk-in").alias("customer"), "staff",
                     "order_date", "status", "total_amount",
                     F.coalesce("items", F.lit(0)).cast("long").alias("items")))


def purchase_history(purchases: DataFrame, suppliers: DataFrame, ingredients: DataFrame,
                     n: int = 15) -> DataFrame:
    """Latest ``n`` purchases (by id) with supplier, ingredient and unit.

    Purchases whose supplier or ingredient is missing drop out by semi joins
    on the keys alone; the top-k then keeps n rows per task, and only those n
    rows fetch their names.
    """
    top = (purchases.join(suppliers.select("supplier_id").distinct(), "supplier_id", "left_semi")
           .join(ingredients.select("ingredient_id").distinct(), "ingredient_id", "left_semi")
           .orderBy(F.col("purchase_id").desc()).limit(n))
    s = suppliers.select("supplier_id", F.col("name").alias("supplier"))
    i = ingredients.select("ingredient_id", F.col("name").alias("ingredient"), "unit")
    return (top.join(s, "supplier_id").join(i, "ingredient_id")
            .select("purchase_id", "supplier", "ingredient", "quantity", "unit", "cost",
                    "purchase_date")
            .orderBy(F.col("purchase_id").desc()))


def recipe_report(recipes: DataFrame, menu_items: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Food, ingredient, qty_required, unit sorted by food, ingredient."""
    m = menu_items.select("menu_id", F.col("name").alias("food"))
    i = ingredients.select("ingredient_id", F.col("name").alias("ingredient"), "unit")
    return (recipes.join(m, "menu_id").join(i, "ingredient_id")
            .select("food", "ingredient", "qty_required", "unit")
            .orderBy("food", "ingredient", "qty_required"))


def account_directory(users: DataFrame, customers: DataFrame) -> DataFrame:
    """Users with display name = customer name, else username."""
    c = customers.select("customer_id", F.col("name").alias("customer_name"))
    return (users.join(c, "customer_id", "left")
                 .select("user_id", "username", "role", "customer_id", "customer_name",
                         X.name_or("customer_name", "username").alias("display_name")))


def login_audit(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """Batch of login attempts (seq, username, password) -> ok flag.

    ok iff the trimmed username exists and sha256(password) equals the stored
    hash.  Left join on the unique username: one output row per attempt.
    """
    a = attempts.select("seq", F.trim("username").alias("username"), "password")
    u = users.select("username", F.col("password").alias("stored"), "role", "customer_id")
    j = a.join(u, "username", "left")
    ok = F.coalesce(F.col("stored") == X.password_hash("password"), F.lit(False))
    return j.select("seq", "username", ok.alias("ok"),
                    F.when(ok, F.col("role")).alias("role"),
                    F.when(ok, F.col("customer_id")).alias("customer_id"))


def join_semi(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents that have at least one child.  The child keys are made
    distinct first (map-side combined), so a hot key shuffles as one row per task."""
    keys = children.select(key).filter(F.col(key).isNotNull()).distinct()
    return parents.join(keys, key, "left_semi")


def join_anti(children: DataFrame, parents: DataFrame, key: str,
              parent_key: str | None = None) -> DataFrame:
    """Children whose (non-NULL) key has no parent row."""
    pk = parent_key or key
    p = parents.select(F.col(pk).alias(key))
    return children.filter(F.col(key).isNotNull()).join(p, key, "left_anti")
