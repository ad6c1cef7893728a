"""Aggregations.

Every group-by here is a hash aggregate with a map-side partial step, so a
hot key (one menu item with a third of all lines) is combined inside each
task before the shuffle; the shuffle carries one partial row per key and
task.  Where the reference aggregates after an outer join, the child side is
aggregated first and then joined (one row per parent crosses the join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import exprs as X


def count_rows(df: DataFrame, condition=None) -> DataFrame:
    """A1: COUNT(*) (optionally of rows meeting ``condition``) as one row."""
    c = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return df.agg(c.cast("long").alias("n"))


def count_col(df: DataFrame, col: str) -> DataFrame:
    """A2: COUNT(col) — NULLs are not counted."""
    return df.agg(F.count(col).cast("long").alias("n"))


def sum_or_zero(df: DataFrame, col, condition=None) -> DataFrame:
    """A3: IFNULL(SUM(x), 0) over rows meeting ``condition``."""
    d = df if condition is None else df.filter(condition)
    return d.agg(X.sum_or_zero(col).alias("total"))


def dashboard_kpis(menu_items: DataFrame, orders: DataFrame, ingredients: DataFrame) -> DataFrame:
    """A4: six KPIs in three scans (one conditional aggregate per table).

    Each side is a single-row global aggregate; the three one-row results are
    united (each with its own columns) and folded into one row.
    """
    m = menu_items.agg(F.count(F.lit(1)).alias("total_food"),
                       F.count_if(F.col("discount") > 0).alias("offer_count"))
    o = orders.agg(F.count(F.lit(1)).alias("total_orders"),
                   F.coalesce(F.sum(F.when(F.col("status") == "Paid", F.col("total_amount"))),
                              F.lit(0)).alias("total_sales"))
    i = ingredients.agg(X.sum_or_zero(X.stock_value()).alias("stock_value"),
                        F.count_if(X.is_low()).alias("low_count"))
    one = m.unionByName(o, allowMissingColumns=True).unionByName(i, allowMissingColumns=True)
    return one.agg(*[F.max(c).alias(c) for c in (
        "total_food", "offer_count", "total_orders", "total_sales", "stock_value", "low_count")])


def daily_sales(orders: DataFrame) -> DataFrame:
    """A5 (Q10) / view v_daily_sales: Paid orders per calendar day."""
    return (orders.filter(F.col("status") == "Paid")
                  .groupBy(X.day_of("order_date").alias("day"))
                  .agg(F.count(F.lit(1)).alias("total_orders"),
                       F.sum("total_amount").alias("total_sales"))
                  .orderBy("day"))


def best_sellers(order_items: DataFrame, menu_items: DataFrame) -> DataFrame:
    """A6 (Q11): plates sold per (menu_id, name); ties broken by menu_id.

    Quantities are summed per menu_id before the join with the menu, so one
    row per item (not per line) is joined.
    """
    per = order_items.groupBy("menu_id").agg(F.sum("quantity").alias("sold"))
    m = menu_items.select("menu_id", "name")
    return (per.join(m, "menu_id")
               .select("menu_id", "name", F.col("sold").cast("long").alias("sold"))
               .orderBy(F.col("sold").desc(), "menu_id"))


def best_sellers_revenue(order_items: DataFrame, menu_items: DataFrame) -> DataFrame:
    """A7 (report): sold and revenue per item *name* (namesakes merge).

    Two-step aggregation: per menu_id first (map-side combined), then per
    name after joining one row per item.
    """
    per = (order_items.groupBy("menu_id")
                      .agg(F.sum("quantity").alias("sold"),
                           F.sum(X.line_subtotal()).alias("revenue")))
    m = menu_items.select("menu_id", "name")
    return (per.join(m, "menu_id").groupBy("name")
               .agg(F.sum("sold").cast("long").alias("sold"),
                    F.sum("revenue").alias("revenue"))
               .orderBy(F.col("sold").desc(), "name"))


def supplier_cost_having(suppliers: DataFrame, purchases: DataFrame,
                         threshold: float = 5000) -> DataFrame:
    """A8 (Q12): SUM(cost) per (supplier_id, name), HAVING > threshold."""
    per = purchases.groupBy("supplier_id").agg(F.sum("cost").alias("total_cost"))
    return (suppliers.select("supplier_id", "name").join(per, "supplier_id")
                     .filter(F.col("total_cost") > threshold)
                     .orderBy(F.col("total_cost").desc(), "supplier_id"))


def employee_sales(employees: DataFrame, orders: DataFrame) -> DataFrame:
    """A9 (Q14): orders handled and sales per employee, 0 for idle staff."""
    per = orders.groupBy("employee_id").agg(F.count("order_id").alias("n"),
                                            F.sum("total_amount").alias("s"))
    return (employees.select("employee_id", "name", "role").join(per, "employee_id", "left")
                     .select("employee_id", "name", "role",
                             F.coalesce("n", F.lit(0)).cast("long").alias("orders_handled"),
                             F.coalesce("s", F.lit(0)).cast("decimal(20,2)").alias("sales"))
                     .orderBy(F.col("sales").desc(), "employee_id"))


def customer_spend(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """A10 (report): orders and spend per customer *name*, HAVING spend > 0."""
    per = (orders.filter(F.col("customer_id").isNotNull())
                 .groupBy("customer_id").agg(F.count("order_id").alias("n"),
                                             F.sum("total_amount").alias("s")))
    return (customers.select("customer_id", "name").join(per, "customer_id", "left")
                     .groupBy("name")
                     .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("orders"),
                          X.sum_or_zero("s").alias("total_spent"))
                     .filter(F.col("total_spent") > 0)
                     .orderBy(F.col("total_spent").desc(), "name"))


def supplier_purchases(suppliers: DataFrame, purchases: DataFrame) -> DataFrame:
    """A11 (report): purchases and total cost per supplier *name*; 0 kept."""
    per = purchases.groupBy("supplier_id").agg(F.count("purchase_id").alias("n"),
                                               F.sum("cost").alias("c"))
    return (suppliers.select("supplier_id", "name").join(per, "supplier_id", "left")
                     .groupBy(F.col("name").alias("supplier"))
                     .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("purchases"),
                          X.sum_or_zero("c").alias("total_cost"))
                     .orderBy(F.col("total_cost").desc(), "supplier"))


def stock_totals(ingredients: DataFrame) -> DataFrame:
    """Items, ROUND(SUM(stock value),2), ROUND(AVG(unit_price),2)."""
    return ingredients.agg(F.count(F.lit(1)).cast("long").alias("items"),
                           F.round(F.sum(X.stock_value()), 2).alias("stock_value"),
                           F.round(F.avg("unit_price"), 2).alias("avg_unit_price"))


def my_orders(orders: DataFrame, order_items: DataFrame,
              customer_ids: DataFrame | None = None) -> DataFrame:
    """customers' orders with item count, newest first.

    ``customer_ids`` (frame with customer_id) restricts to requesting
    customers via a semi join; None lists every customer's orders, keyed by
    customer_id.
    """
    o = orders.filter(F.col("customer_id").isNotNull())
    if customer_ids is not None:
        o = o.join(customer_ids.select("customer_id"), "customer_id", "left_semi")
    items = order_items.groupBy("order_id").agg(F.count("menu_id").alias("items"))
    return (o.join(items, "order_id", "left")
             .select("customer_id", "order_id", "order_date", "status", "total_amount",
                     F.coalesce("items", F.lit(0)).cast("long").alias("items"))
             .orderBy("customer_id", F.col("order_id").desc()))


def menu_by_category(menu_items: DataFrame) -> DataFrame:
    """Available items under their category in name order, as flat rows
    (category, position, name, menu_id, price, discount, final_price).

    ``position`` counts from 1 within the category by name (then id).  It is
    a two-level running count, so a category of any size is never one list
    or one task.
    """
    from larder.operators.windows import running_total
    items = (menu_items.filter(F.col("is_available") == 1)
             .select("category", "name", "menu_id", "price", "discount",
                     X.final_price().alias("final_price"), F.lit(1).cast("long").alias("_one")))
    run = running_total(items, "category", ["name", "menu_id"], "_one", out="position")
    return run.select("category", "position", "name", "menu_id", "price", "discount",
                      "final_price")


def bill_with_total(order_items: DataFrame, menu_items: DataFrame) -> DataFrame:
    """Every order's bill lines plus one total row per order.

    ``row_kind`` is 'line' or 'total'; the total row has name NULL and
    subtotal = Σ quantity*price.  Lines and totals are unioned (equal lines
    stay separate rows).
    """
    from larder.operators.joins import order_bill_lines
    lines = order_bill_lines(order_items, menu_items).withColumn("row_kind", F.lit("line"))
    totals = (order_items.groupBy("order_id")
                         .agg(F.sum(X.line_subtotal()).alias("subtotal"))
                         .select("order_id", F.lit(None).cast("string").alias("name"),
                                 F.lit(None).cast("int").alias("quantity"),
                                 F.lit(None).cast("decimal(10,2)").alias("price"),
                                 "subtotal", F.lit("total").alias("row_kind")))
    return lines.unionByName(totals)


def cart_lines(carts: DataFrame) -> DataFrame:
    """Explode a cart map<menu_id, struct<name, qty>> into (cart_id, menu_id, qty)."""
    return carts.select("cart_id", F.explode("cart").alias("menu_id", "line")).select(
        "cart_id", "menu_id", F.col("line.qty").alias("qty"))


def cart_totals(carts: DataFrame, menu_items: DataFrame) -> DataFrame:
    """Per cart grand = Σ final*qty, saved = Σ (price-final)*qty.

    Unknown menu ids are skipped (inner join); availability is not checked.
    """
    lines = cart_lines(carts)
    m = menu_items.select("menu_id", "price", X.final_price().alias("final_price"))
    j = lines.join(m, "menu_id")
    return (j.groupBy("cart_id")
             .agg(F.sum(F.col("final_price") * F.col("qty")).alias("grand"),
                  F.sum((F.col("price") - F.col("final_price")) * F.col("qty")).alias("saved")))


def cart_count(carts: DataFrame) -> DataFrame:
    """Σ qty over each cart map, computed inside the row (no shuffle)."""
    return carts.select("cart_id", F.aggregate(F.map_values("cart"), F.lit(0).cast("long"),
                                               lambda acc, x: acc + x["qty"]).alias("cart_count"))


def result_count(df: DataFrame) -> DataFrame:
    """Rows in a result set as a one-row frame."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("rows"))


def order_reconcile(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Stored total vs Σ(price*quantity) of the order's lines."""
    per = order_items.groupBy("order_id").agg(F.sum(X.line_subtotal()).alias("s"))
    j = orders.select("order_id", "total_amount").join(per, "order_id", "left")
    items_total = F.coalesce("s", F.lit(0))
    return j.select("order_id", "total_amount", items_total.alias("items_total"),
                    (F.col("total_amount") - items_total).alias("difference"))
