"""Stand-in restaurant tables derived from the driver's TPC-H-like parquet.

The derivation only reshapes rows into the restaurant schema (ids, names,
prices, statuses); it does none of the jobs' work.  The jobs are written for
any data of that schema and take nothing from how these rows are made.  The
same derivation is written in SQL for the DuckDB oracle
(``larder.plans.oracle_sql.PREFIX``); both must stay identical.

Everything is lazy: Catalyst prunes the columns and rows a job does not use
and pushes filters into the parquet scans.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.schemas import MONEY, PERCENT, conform

SOURCE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events"]


ORDER_STRIDE = 1 << 20


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _id_within_order(df: DataFrame) -> DataFrame:
    """Unique row id for lineitem rows: order key * 2^20 + position in the order
    (an order with 2^20 lines or more raises instead of colliding).

    (l_orderkey, l_linenumber) is not unique in the driver data, so the
    position is a row_number within the order over all columns.  The window is
    partitioned by order (a handful of lines each), so it scales; Catalyst
    drops it when the id is not selected.
    """
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_shipdate")
    n = F.row_number().over(w)
    return df.withColumn("_row_id", F.when(n < ORDER_STRIDE, F.col("l_orderkey") * ORDER_STRIDE + n)
                         .otherwise(F.raise_error(F.lit("an order has too many lines"))))


def suppliers(spark, d):
    s = read_source(spark, d, "supplier")
    return conform(s.select(
        F.col("s_suppkey").alias("supplier_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("0171"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0")).alias("phone"),
        F.when(F.col("s_suppkey") % 4 == 3, F.lit(None)).otherwise(
            F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string"),
                     F.lit("@example.com"))).alias("email"),
        F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("address"),
    ), "suppliers")


def ingredients(spark, d):
    p = read_source(spark, d, "part")
    n_sup = read_source(spark, d, "supplier").select(F.count(F.lit(1))).scalar()
    return conform(p.select(
        F.col("p_partkey").alias("ingredient_id"),
        F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_size") % 3 == 0, "kg").when(F.col("p_size") % 3 == 1, "litre")
         .otherwise("pcs").alias("unit"),
        F.col("p_size").cast(MONEY).alias("quantity"),
        (F.col("p_partkey") % 20 + 10).cast(MONEY).alias("reorder_level"),
        F.col("p_retailprice").cast(MONEY).alias("unit_price"),
        # every 6th part has no supplier; the modulus runs 5 past the supplier
        # count, so a few references dangle (exercises the FK audit)
        F.when(F.col("p_partkey") % 6 == 0, F.lit(None))
         .otherwise(F.col("p_partkey") % (n_sup + 5)).alias("supplier_id"),
    ), "ingredients")


def purchases(spark, d):
    li = read_source(spark, d, "lineitem").filter(F.col("l_returnflag") == "R")
    li = _id_within_order(li)
    return conform(li.select(
        F.col("_row_id").alias("purchase_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_partkey").alias("ingredient_id"),
        F.col("l_quantity").cast(MONEY).alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("cost"),
        F.to_date("l_shipdate").alias("purchase_date"),
    ), "purchases")


def menu_items(spark, d):
    p = read_source(spark, d, "part")
    return conform(p.select(
        F.col("p_partkey").alias("menu_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
        ((F.col("p_size") % 5) * 5).cast(PERCENT).alias("discount"),
        F.when(F.col("p_size") % 7 != 0, 1).otherwise(0).alias("is_available"),
    ), "menu_items")


def recipes(spark, d):
    p = read_source(spark, d, "part")
    n_part = p.select(F.count(F.lit(1))).scalar()
    # 1..4 ingredients per item; every 13th item has no recipe
    r = (p.filter(F.col("p_partkey") % 13 != 0)
          .select("p_partkey", F.explode(F.sequence(F.lit(0), (F.col("p_partkey") % 4).cast("int")))
                  .alias("k")))
    return conform(r.select(
        F.col("p_partkey").alias("menu_id"),
        ((F.col("p_partkey") * 7 + F.col("k")) % n_part).alias("ingredient_id"),
        ((F.col("k") + 1) * F.lit(0.05).cast("decimal(3,2)")).cast(MONEY).alias("qty_required"),
    ), "recipes")


def customers(spark, d):
    c = read_source(spark, d, "customer")
    return conform(c.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("0181"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("phone"),
    ), "customers")


# Fixed role names of the reference's staff.
_ROLES = ["Manager", "Chef", "Waiter", "Cashier"]


def employees(spark, d):
    n = read_source(spark, d, "nation")
    k = F.col("n_nationkey")
    role = (F.when(k % 4 == 0, _ROLES[0]).when(k % 4 == 1, _ROLES[1])
             .when(k % 4 == 2, _ROLES[2]).otherwise(_ROLES[3]))
    return conform(n.select(
        k.alias("employee_id"),
        F.col("n_name").alias("name"),
        role.alias("role"),
        F.concat(F.lit("0191"), F.lpad(k.cast("string"), 7, "0")).alias("phone"),
        (k * 1000 + 18000).cast(MONEY).alias("salary"),
        F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int")).alias("hire_date"),
    ), "employees")


def orders(spark, d):
    return orders_of(read_source(spark, d, "orders"))


def orders_of(o):
    """Orders from the driver's rows, stored or as a stream."""
    key = F.col("o_orderkey")
    status = (F.when(key % 17 == 0, "Cancelled")
               .when(F.col("o_orderstatus") == "F", "Paid")
               .when(F.col("o_orderstatus") == "O", "Served")
               .otherwise("Pending"))
    return conform(o.select(
        key.alias("order_id"),
        F.when(F.col("o_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("o_custkey"))
         .alias("customer_id"),
        (key % 20).alias("employee_id"),
        F.col("o_orderdate").alias("order_date"),
        status.alias("status"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
    ), "orders")


def _line_columns():
    price = F.round(F.col("l_extendedprice").cast("decimal(12,2)")
                    * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")), 2)
    return [F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("menu_id"),
            F.col("l_quantity").cast("int").alias("quantity"), price.cast(MONEY).alias("price")]


def order_items(spark, d):
    li = _id_within_order(read_source(spark, d, "lineitem"))
    return conform(li.select(F.col("_row_id").alias("order_item_id"), *_line_columns()), "order_items")


def lines_of(li):
    """Order lines without ids from a stream of the driver's rows."""
    return li.select(*_line_columns())


def buys_of(li):
    """Purchases without ids from a stream of the driver's rows."""
    return li.filter(F.col("l_returnflag") == "R").select(
        F.col("l_partkey").alias("ingredient_id"), F.col("l_quantity").cast(MONEY).alias("quantity"))


def users(spark, d):
    c = read_source(spark, d, "customer")
    k = F.col("c_custkey")
    admin = k % 50 == 0
    return conform(c.select(
        (k + 1).alias("user_id"),
        F.lower(F.col("c_name")).alias("username"),
        F.sha2(F.concat(F.lit("pw"), k.cast("string")), 256).alias("password"),
        F.when(admin, "admin").otherwise("customer").alias("role"),
        F.when(admin, F.lit(None)).otherwise(k).alias("customer_id"),
    ), "users")


def carts(spark, d):
    """Session carts (cart_id, map<menu_id, struct<name, qty>>): one per
    order, holding that order's lines."""
    lines = (order_items(spark, d)
             .groupBy("order_id", "menu_id").agg(F.sum("quantity").alias("qty")))
    m = menu_items(spark, d).select("menu_id", "name")
    return (lines.join(m, "menu_id")
            .groupBy(F.col("order_id").alias("cart_id"))
            .agg(F.map_from_entries(F.collect_list(F.struct(
                "menu_id", F.struct("name", F.col("qty").cast("int").alias("qty"))))).alias("cart")))


def login_attempts(spark, d):
    """(seq, username, password): every account tries once; some names carry
    blanks, every 3rd gives a wrong password, every 7th an unknown name."""
    c = read_source(spark, d, "customer")
    k = F.col("c_custkey")
    name = F.lower(F.col("c_name"))
    return c.select(
        k.alias("seq"),
        F.when(k % 7 == 0, F.concat(name, F.lit("x")))
         .when(k % 5 == 0, F.concat(F.lit("  "), name, F.lit(" ")))
         .otherwise(name).alias("username"),
        F.when(k % 3 == 0, F.lit("wrong")).otherwise(F.concat(F.lit("pw"), k.cast("string")))
         .alias("password"))


def bill_requests(spark, d):
    """(order_id, customer_id): a customer asks to see an order's bill; every
    3rd request names another customer's order."""
    o = read_source(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("order_id"),
                    F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1)
                     .otherwise(F.col("o_custkey")).alias("customer_id"))


# ---------------------------------------------------------------- change inputs
# Rows in the shape of the admin/customer forms, one row per submitted form.

def _null(t):
    return F.lit(None).cast(t)


def menu_changes(spark, d):
    """(seq, op, menu_id, name, category, price, discount, is_available):
    updates (some invalid, some ids updated twice), adds (blank names,
    duplicates inside the batch and of existing names) and deletes."""
    p = read_source(spark, d, "part")
    k, g = F.col("p_partkey"), F.col("p_partkey") % 11
    op = (F.when(g.isin(0, 5), "update").when(g.isin(1, 2), "add").when(g == 3, "delete"))
    name = (F.when(g == 1, F.when(k % 55 == 1, F.lit("  "))
                   .otherwise(F.concat(F.col("p_name"), F.lit(" special"))))
             .when(g == 2, F.col("p_name")))
    price = (F.when(g == 0, F.when(k % 77 == 0, F.lit(0)).otherwise(F.col("p_retailprice")
                                                                    + F.col("p_size")))
              .when(g == 5, F.col("p_retailprice") + 1)
              .when(g.isin(1, 2), F.col("p_retailprice")))
    disc = (F.when(g == 0, F.when(k % 121 == 0, F.lit(150)).otherwise((F.col("p_size") % 3) * 10))
             .when(g == 5, F.lit(5))
             .when(g.isin(1, 2), F.when(k % 33 == 1, F.lit(-5)).otherwise((F.col("p_size") % 4) * 5)))
    avail = (F.when(g == 0, F.when(F.col("p_size") % 2 == 0, F.lit(1))).when(g == 5, F.lit(1)))
    menu_id = F.when(g.isin(0, 3), k).when(g == 5, k - 5)
    return p.filter(g.isin(0, 1, 2, 3, 5)).select(
        k.alias("seq"), op.alias("op"), menu_id.alias("menu_id"), name.alias("name"),
        F.when(g.isin(1, 2), F.col("p_type")).alias("category"),
        price.cast("decimal(10,2)").alias("price"), disc.cast("decimal(5,2)").alias("discount"),
        avail.cast("int").alias("is_available"))


def ingredient_changes(spark, d):
    """(seq, op, ingredient_id, name, unit, quantity, reorder_level,
    unit_price, supplier_id): updates (some negative), adds (some duplicate
    names, some without supplier) and deletes."""
    p = read_source(spark, d, "part")
    k, g = F.col("p_partkey"), F.col("p_partkey") % 13
    op = F.when(g == 0, "update").when(g == 1, "add").when(g == 2, "delete")
    name = F.when(g == 1, F.when(k % 26 == 1, F.concat(F.lit("new "), F.col("p_name")))
                  .otherwise(F.concat(F.lit("new "), F.col("p_name"), F.lit(" #"),
                                      k.cast("string"))))
    return p.filter(g.isin(0, 1, 2)).select(
        k.alias("seq"), op.alias("op"),
        F.when(g.isin(0, 2), k).alias("ingredient_id"), name.alias("name"),
        F.when(g == 1, F.lit("kg")).alias("unit"),
        F.when(g == 0, F.col("p_size") + 5).when(g == 1, F.col("p_size"))
         .cast("decimal(10,2)").alias("quantity"),
        F.when(g == 0, F.lit(12)).when(g == 1, F.lit(5)).cast("decimal(10,2)")
         .alias("reorder_level"),
        F.when(g == 0, F.when(k % 39 == 0, F.lit(-1)).otherwise(F.col("p_retailprice")))
         .when(g == 1, F.col("p_retailprice")).cast("decimal(10,2)").alias("unit_price"),
        F.when((g == 1) & (k % 3 != 0), k % 100).cast("long").alias("supplier_id"))


def status_changes(spark, d):
    """(seq, order_id, actor, customer_id, status): staff changes (one value
    not allowed), customer cancels (some by another customer), repeats."""
    return status_changes_of(read_source(spark, d, "orders"))


def status_changes_of(o):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    staff = o.filter(k % 5 == 0).select(
        (k * 4 + 1).alias("seq"), k.alias("order_id"), F.lit("staff").alias("actor"),
        _null("long").alias("customer_id"),
        F.when(k % 35 == 0, "Done").when(k % 10 == 0, "Pending").otherwise("Paid").alias("status"))
    cancel = o.filter(k % 3 == 0).select(
        (k * 4 + F.when(k % 2 == 0, 0).otherwise(2)).alias("seq"), k.alias("order_id"),
        F.lit("customer").alias("actor"),
        F.when(k % 9 == 0, c + 1).otherwise(c).alias("customer_id"),
        F.lit("Cancelled").alias("status"))
    again = o.filter(k % 6 == 0).select(
        (k * 4 + 3).alias("seq"), k.alias("order_id"), F.lit("customer").alias("actor"),
        c.alias("customer_id"), F.lit("Cancelled").alias("status"))
    return staff.unionByName(cancel).unionByName(again)


def cart_events(spark, d):
    """(cart_id, seq, op, menu_id, qty): add / set / remove clicks."""
    li = _id_within_order(read_source(spark, d, "lineitem"))
    n = F.col("l_linenumber")
    op = F.when(n % 4 == 3, "set").when(n % 6 == 5, "remove").otherwise("add")
    q = F.col("l_quantity").cast("int")
    qty = F.when(n % 4 == 3, q - 20).when(n % 6 == 5, _null("int")).otherwise(q % 7)
    return li.select(F.col("l_orderkey").alias("cart_id"), F.col("_row_id").alias("seq"),
                     op.alias("op"), F.col("l_partkey").alias("menu_id"),
                     qty.cast("int").alias("qty"))


def customer_deletes(spark, d):
    """(customer_id): customers removed by an admin."""
    c = read_source(spark, d, "customer")
    return c.filter(F.col("c_custkey") % 9 == 4).select(F.col("c_custkey").alias("customer_id"))


def supplier_deletes(spark, d):
    """(supplier_id): supplier delete requests, including unknown ids."""
    s = read_source(spark, d, "supplier")
    return s.filter(F.col("s_suppkey") % 4 == 1).select(
        (F.col("s_suppkey") * 2).alias("supplier_id"))


def new_purchases(spark, d):
    """(seq, supplier_id, ingredient_id, quantity, cost, purchase_date): a
    batch of purchase forms (lines with return flag 'A'); some quantities are
    not above 0, every 50th order's costs are negative, every 41st order names
    an unknown supplier, every 43rd an unknown ingredient, every 7th no date."""
    li = _id_within_order(read_source(spark, d, "lineitem").filter(F.col("l_returnflag") == "A"))
    cost = F.when(F.col("l_orderkey") % 50 == 0, -F.col("l_extendedprice")) \
        .otherwise(F.col("l_extendedprice"))
    k = F.col("l_orderkey")
    return li.select(F.col("_row_id").alias("seq"),
                     F.when(k % 41 == 0, -F.col("l_suppkey") - 1).otherwise(F.col("l_suppkey"))
                      .alias("supplier_id"),
                     F.when(k % 43 == 0, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey"))
                      .alias("ingredient_id"),
                     (F.col("l_quantity") - 3).cast("decimal(10,2)").alias("quantity"),
                     cost.cast("decimal(10,2)").alias("cost"),
                     F.when(k % 7 != 0, F.to_date("l_shipdate")).alias("purchase_date"))


def order_deletes(spark, d):
    """(order_id): orders removed by an admin."""
    o = read_source(spark, d, "orders")
    return o.filter(F.col("o_orderkey") % 11 == 5).select(F.col("o_orderkey").alias("order_id"))


def employee_deletes(spark, d):
    """(employee_id): staff delete requests, including unknown ids."""
    n = read_source(spark, d, "nation")
    return n.select((F.col("n_nationkey") * 2).cast("long").alias("employee_id"))


def ingredient_deletes(spark, d):
    """(ingredient_id): ingredient delete requests, including unknown ids."""
    p = read_source(spark, d, "part")
    return p.filter(F.col("p_partkey") % 3 == 1).select(
        (F.col("p_partkey") + F.col("p_partkey") % 2 * 1_000_000).alias("ingredient_id"))


def price_log(spark, d):
    """(menu_id, valid_from, price, discount, is_available): the menu's
    price history — an opening version and later changes."""
    p = read_source(spark, d, "part")
    k = F.col("p_partkey")
    base = p.select(k.alias("menu_id"), F.lit("1990-01-01 00:00:00").cast("timestamp_ntz")
                    .alias("valid_from"), F.col("p_retailprice").alias("price"),
                    F.lit(0).alias("discount"), F.lit(1).alias("is_available"))
    up = p.filter(k % 3 == 0).select(
        k.alias("menu_id"), F.lit("1997-01-01 00:00:00").cast("timestamp_ntz").alias("valid_from"),
        (F.col("p_retailprice") + 10).alias("price"), F.lit(0).alias("discount"),
        F.lit(1).alias("is_available"))
    promo = p.filter(k % 5 == 0).select(
        k.alias("menu_id"), F.lit("1999-06-01 00:00:00").cast("timestamp_ntz").alias("valid_from"),
        F.col("p_retailprice").alias("price"), F.lit(20).alias("discount"),
        F.when(k % 35 == 0, 0).otherwise(1).alias("is_available"))
    out = base.unionByName(up).unionByName(promo)
    return out.select("menu_id", "valid_from", F.col("price").cast("decimal(10,2)").alias("price"),
                      F.col("discount").cast("decimal(5,2)").alias("discount"),
                      F.col("is_available").cast("int").alias("is_available"))


_BUILDERS = {
    "suppliers": suppliers, "ingredients": ingredients, "purchases": purchases,
    "menu_items": menu_items, "recipes": recipes, "customers": customers,
    "employees": employees, "orders": orders, "order_items": order_items, "users": users,
    "carts": carts, "login_attempts": login_attempts, "bill_requests": bill_requests,
    "menu_changes": menu_changes, "ingredient_changes": ingredient_changes,
    "status_changes": status_changes, "cart_events": cart_events,
    "customer_deletes": customer_deletes, "supplier_deletes": supplier_deletes,
    "price_log": price_log, "new_purchases": new_purchases, "order_deletes": order_deletes,
    "employee_deletes": employee_deletes, "ingredient_deletes": ingredient_deletes,
}


@dataclass
class Tables:
    """Lazily built restaurant tables over one driver directory."""

    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in _BUILDERS:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = _BUILDERS[name](self.spark, self.sf_dir)
        return self._cache[name]

    def source(self, name: str) -> DataFrame:
        return read_source(self.spark, self.sf_dir, name)

    def as_dict(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in _BUILDERS}


_MEMO: dict[tuple[int, str], Tables] = {}


def from_driver(spark: SparkSession, sf_dir: str) -> Tables:
    """Tables over ``sf_dir``, shared by all queries of one session (frames are
    immutable and lazy, so sharing only saves plan construction)."""
    key = (id(spark), sf_dir.rstrip("/"))
    t = _MEMO.get(key)
    if t is None or t.spark is not spark:
        t = _MEMO[key] = Tables(spark, sf_dir)
    return t
