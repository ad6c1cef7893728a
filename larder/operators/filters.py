"""Projections, filters and predicates (P1-P16) and sorts.

Filters are plain Column predicates, so Catalyst pushes the ones on stored
columns into the parquet scan (``PushedFilters``) and prunes unused columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import exprs as X
from larder.schemas import ORDER_STATUSES


def scan_all(df: DataFrame) -> DataFrame:
    """S1 (Q1): every column of a table."""
    return df.select("*")


def project_cols(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Column list with aliases {source: alias}."""
    return df.select(*[F.col(s).alias(a) for s, a in mapping.items()])


def filter_and_eq(menu_items: DataFrame, category: str = "Main") -> DataFrame:
    """P2 (Q2): available items of one category, cheapest first."""
    return (menu_items.filter((F.col("category") == category) & (F.col("is_available") == 1))
                      .select("menu_id", "name", "price")
                      .orderBy("price", "menu_id"))


def final_price_list(menu_items: DataFrame) -> DataFrame:
    """P3 (Q3c): available items with the price after discount, by discount."""
    return (menu_items.filter(F.col("is_available") == 1)
                      .select("menu_id", "name", "price", "discount",
                              X.final_price().alias("final_price"))
                      .orderBy(F.col("discount").desc(), "menu_id"))


def discounted_items(menu_items: DataFrame) -> DataFrame:
    """P4 (Q1b + report): items with discount > 0, final price and saving."""
    return (menu_items.filter(F.col("discount") > 0)
                      .select("menu_id", "name", "category", "price", "discount",
                              X.final_price().alias("final_price"),
                              X.you_save().alias("you_save"))
                      .orderBy(F.col("discount").desc(), "menu_id"))


def menu_listing(menu_items: DataFrame, admin: bool = False) -> DataFrame:
    """P5: customer menu (available only) or admin list (all + is_available)."""
    m = menu_items if admin else menu_items.filter(F.col("is_available") == 1)
    cols = ["menu_id", "name", "category", "price", "discount",
            X.final_price().alias("final_price")]
    if admin:
        cols.append("is_available")
    return m.select(*cols).orderBy("category", "name", "menu_id")


def low_stock(ingredients: DataFrame) -> DataFrame:
    """P6 (Q9): quantity <= reorder_level (column-to-column, inclusive)."""
    return ingredients.filter(X.is_low()).select("ingredient_id", "name", "quantity", "unit",
                                                 "reorder_level")


def stock_value(ingredients: DataFrame) -> DataFrame:
    """P7 (Q15): quantity * unit_price, highest first."""
    return (ingredients.select("ingredient_id", "name", "quantity", "unit_price",
                               X.stock_value().alias("stock_value"))
                       .orderBy(F.col("stock_value").desc(), "ingredient_id"))


def line_subtotal(order_items: DataFrame) -> DataFrame:
    """Quantity * price per order line."""
    return order_items.select("order_item_id", "order_id", "menu_id", "quantity", "price",
                              X.line_subtotal().alias("subtotal"))


def name_search(df: DataFrame, text: str, col: str = "name") -> Column:
    """Predicate ``col LIKE '%text%'`` (case-insensitive, raw wildcards)."""
    return X.like_contains(col, text)


def stock_status_condition(search: str = "", status: str = "all") -> Column | None:
    """P10: AND of an optional name search and a stock status.

    status 'low' -> quantity <= reorder_level, 'in_stock' -> quantity >
    reorder_level, any other value -> no status condition.
    """
    conds: list[Column] = []
    s = search.strip()
    if s:
        conds.append(X.like_contains("name", s))
    if status == "low":
        conds.append(X.is_low())
    elif status == "in_stock":
        conds.append(~X.is_low())
    return reduce(lambda a, b: a & b, conds) if conds else None


def order_status_filter(orders: DataFrame, status: str | None) -> DataFrame:
    """One of the four statuses; any other value means no filter."""
    return orders.filter(F.col("status") == status) if status in ORDER_STATUSES else orders


def in_list(df: DataFrame, col: str, values: list) -> DataFrame:
    """``col IN (values)``."""
    return df.filter(F.col(col).isin(values))


def key_param_filter(df: DataFrame, key: str, keys) -> DataFrame:
    """Rows whose ``key`` matches a bound value, or — for many keys — a
    key table (left semi join; Spark broadcasts the key table when its
    measured size is under the broadcast threshold)."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key), key, "left_semi")
    return df.filter(F.col(key) == F.lit(keys))


def scalar_subquery(menu_items: DataFrame) -> DataFrame:
    """P14 (Q13): items priced above the average price of all items.

    The average is a scalar subquery (one partial-avg pass); Catalyst
    evaluates it once and uses it as a literal in the filter.
    """
    avg = menu_items.select(F.avg("price")).scalar()
    return (menu_items.filter(F.col("price") > avg)
                      .select("menu_id", "name", "price")
                      .orderBy(F.col("price").desc(), "menu_id"))


def in_subquery(ingredients: DataFrame, recipes: DataFrame, menu_keys: DataFrame) -> DataFrame:
    """Ingredients used in the recipe of any menu item in ``menu_keys``
    (``ingredient_id IN (SELECT ... FROM recipes WHERE menu_id IN ...)``)."""
    used = recipes.join(menu_keys.select("menu_id").distinct(), "menu_id", "left_semi")
    return ingredients.join(used.select("ingredient_id").distinct(), "ingredient_id", "left_semi")


def correlated_scalar(order_items: DataFrame, recipes: DataFrame) -> DataFrame:
    """Per order line and recipe ingredient, qty_required * quantity.

    The reference's correlated scalar subquery (single row thanks to the
    composite key) decorrelates to an equi-join on menu_id.
    """
    return (order_items.select("order_item_id", "order_id", "menu_id", "quantity")
                       .join(recipes, "menu_id")
                       .select("order_item_id", "order_id", "menu_id", "ingredient_id",
                               (F.col("qty_required") * F.col("quantity")).alias("used")))


# ---- sorts (O1-O5) ----

def sort_asc_desc(df: DataFrame, col: str, descending: bool = False, tie: str | None = None):
    """O1: one sort key (plus an optional tie-break key)."""
    keys = [F.col(col).desc() if descending else F.col(col).asc()]
    if tie:
        keys.append(F.col(tie))
    return df.orderBy(*keys)


def sort_multi(df: DataFrame, *cols: str) -> DataFrame:
    """O2: several ascending keys."""
    return df.orderBy(*cols)


def sort_boolean(ingredients: DataFrame) -> DataFrame:
    """O3: low stock first (boolean DESC), then name."""
    return ingredients.orderBy(X.is_low().desc(), "name", "ingredient_id")


def topk(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """First ``n`` rows by ``keys`` (TakeOrderedAndProject: n rows per task)."""
    return df.orderBy(*keys).limit(n)


def first_waiter(employees: DataFrame) -> DataFrame:
    """The first Waiter by id, else the first employee by id."""
    return (employees.orderBy(F.when(F.col("role") == "Waiter", 0).otherwise(1),
                              "employee_id")
                     .limit(1).select("employee_id", "name", "role"))
