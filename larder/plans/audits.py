"""Registered data-quality audits.

The audits run over the ten restaurant tables with breaches put in: for each
rule, the rows whose key has a certain remainder mod 25 break it (``BREACHES``,
an input derivation written once as SQL expressions both engines read).  The
oracle's rules are written out by hand, table by table, from the schema.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import quality as Q
from larder.plans.registry import register
from larder.schemas import SCHEMAS
from larder.session import stored


# (table, key) -> column -> expression; the key's remainder r mod 25 picks the
# rule that a row breaks: NULLs first, then CHECKs, lengths, duplicates (two remainders) and
# dangling references.
KEYS = {"suppliers": "supplier_id", "ingredients": "ingredient_id", "purchases": "purchase_id",
        "menu_items": "menu_id", "recipes": "menu_id", "customers": "customer_id",
        "employees": "employee_id", "orders": "order_id", "order_items": "order_item_id",
        "users": "user_id"}

BREACHES = {
    "suppliers": {
        "supplier_id": "CASE WHEN r = 0 THEN NULL WHEN r IN (1, 2) THEN 0 ELSE supplier_id END",
        "name": "CASE WHEN r = 3 THEN NULL WHEN r = 4 THEN repeat('n', 101) ELSE name END",
        "phone": "CASE WHEN r = 5 THEN NULL WHEN r = 6 THEN repeat('1', 21) WHEN r IN (7, 8) THEN 'same' ELSE phone END",
        "email": "CASE WHEN r = 9 THEN repeat('e', 101) WHEN r IN (10, 11) THEN 'same' ELSE email END",
        "address": "CASE WHEN r = 12 THEN repeat('a', 151) ELSE address END"},
    "ingredients": {
        "ingredient_id": "CASE WHEN r = 0 THEN NULL WHEN r IN (1, 2) THEN 0 ELSE ingredient_id END",
        "name": "CASE WHEN r = 3 THEN NULL WHEN r = 4 THEN repeat('n', 101) WHEN r IN (5, 6) THEN 'same' ELSE name END",
        "unit": "CASE WHEN r = 7 THEN NULL WHEN r = 8 THEN repeat('u', 11) ELSE unit END",
        "quantity": "CASE WHEN r = 9 THEN NULL WHEN r = 10 THEN -1 ELSE quantity END",
        "reorder_level": "CASE WHEN r = 11 THEN NULL ELSE reorder_level END",
        "unit_price": "CASE WHEN r = 12 THEN NULL WHEN r = 13 THEN -1 ELSE unit_price END",
        "supplier_id": "CASE WHEN r = 14 THEN -1 ELSE supplier_id END"},
    "purchases": {
        "purchase_id": "CASE WHEN r = 0 THEN NULL WHEN r IN (1, 2) THEN 0 ELSE purchase_id END",
        "supplier_id": "CASE WHEN r = 3 THEN NULL WHEN r = 4 THEN -1 ELSE supplier_id END",
        "ingredient_id": "CASE WHEN r = 5 THEN NULL WHEN r = 6 THEN -1 ELSE ingredient_id END",
        "quantity": "CASE WHEN r = 7 THEN NULL WHEN r = 8 THEN 0 ELSE quantity END",
        "cost": "CASE WHEN r = 9 THEN NULL ELSE cost END",
        "purchase_date": "CASE WHEN r = 10 THEN NULL ELSE purchase_date END"},
    "menu_items": {
        "menu_id": "CASE WHEN r = 0 THEN NULL WHEN r IN (1, 2) THEN 0 ELSE menu_id END",
        "name": "CASE WHEN r = 3 THEN NULL WHEN r = 4 THEN repeat('n', 101) WHEN r IN (5, 6) THEN 'same' ELSE name END",
        "category": "CASE WHEN r = 7 THEN NULL WHEN r = 8 THEN repeat('c', 31) ELSE category END",
        "price": "CASE WHEN r = 9 THEN NULL WHEN r = 10 THEN 0 ELSE price END",
        "discount": "CASE WHEN r = 11 THEN NULL WHEN r = 12 THEN -5 WHEN r = 13 THEN 101 ELSE discount END",
        "is_available": "CASE WHEN r = 14 THEN NULL ELSE is_available END"},
    "recipes": {
        "menu_id": "CASE WHEN r = 0 THEN NULL WHEN r = 1 THEN -1 WHEN r IN (2, 3) THEN 1 ELSE menu_id END",
        "ingredient_id": "CASE WHEN r = 4 THEN NULL WHEN r = 5 THEN -1 WHEN r IN (2, 3) THEN 1 ELSE ingredient_id END",
        "qty_required": "CASE WHEN r = 6 THEN NULL ELSE qty_required END"},
    "customers": {
        "customer_id": "CASE WHEN r = 0 THEN NULL WHEN r IN (1, 2) THEN 1 ELSE customer_id END",
        "name": "CASE WHEN r = 3 THEN NULL WHEN r = 4 THEN repeat('n', 101) ELSE name END",
        "phone": "CASE WHEN r = 5 THEN NULL WHEN r = 6 THEN repeat('1', 21) WHEN r IN (7, 8) THEN 'same' ELSE phone END"},
    "employees": {
        "employee_id": "CASE WHEN r = 0 THEN NULL WHEN r IN (1, 2) THEN 1 ELSE employee_id END",
        "name": "CASE WHEN r = 3 THEN NULL WHEN r = 4 THEN repeat('n', 101) ELSE name END",
        "role": "CASE WHEN r = 5 THEN NULL WHEN r = 6 THEN repeat('r', 31) ELSE role END",
        "phone": "CASE WHEN r = 7 THEN NULL WHEN r = 8 THEN repeat('1', 21) WHEN r IN (9, 10) THEN 'same' ELSE phone END",
        "salary": "CASE WHEN r = 11 THEN NULL ELSE salary END",
        "hire_date": "CASE WHEN r = 12 THEN NULL ELSE hire_date END"},
    "orders": {
        "order_id": "CASE WHEN r = 0 THEN NULL WHEN r IN (1, 2) THEN 1 ELSE order_id END",
        "customer_id": "CASE WHEN r = 3 THEN -1 ELSE customer_id END",
        "employee_id": "CASE WHEN r = 4 THEN NULL WHEN r = 5 THEN -1 ELSE employee_id END",
        "order_date": "CASE WHEN r = 6 THEN NULL ELSE order_date END",
        "status": "CASE WHEN r = 7 THEN NULL WHEN r = 8 THEN 'Done' WHEN r = 9 THEN repeat('s', 21) ELSE status END",
        "total_amount": "CASE WHEN r = 10 THEN NULL ELSE total_amount END"},
    "order_items": {
        "order_item_id": "CASE WHEN r = 0 THEN NULL WHEN r IN (1, 2) THEN 1 ELSE order_item_id END",
        "order_id": "CASE WHEN r = 3 THEN NULL WHEN r = 4 THEN -1 ELSE order_id END",
        "menu_id": "CASE WHEN r = 5 THEN NULL WHEN r = 6 THEN -1 ELSE menu_id END",
        "quantity": "CASE WHEN r = 7 THEN NULL WHEN r = 8 THEN 0 ELSE quantity END",
        "price": "CASE WHEN r = 9 THEN NULL ELSE price END"},
    "users": {
        "user_id": "CASE WHEN r = 0 THEN NULL WHEN r IN (1, 2) THEN 1 ELSE user_id END",
        "username": "CASE WHEN r = 3 THEN NULL WHEN r = 4 THEN repeat('u', 51) WHEN r IN (5, 6) THEN 'same' ELSE username END",
        "password": "CASE WHEN r = 7 THEN NULL WHEN r = 8 THEN repeat('p', 256) ELSE password END",
        "role": "CASE WHEN r = 9 THEN NULL WHEN r = 10 THEN 'owner' WHEN r = 11 THEN repeat('r', 11) ELSE role END",
        "customer_id": "CASE WHEN r = 12 THEN -1 ELSE customer_id END"},
}


def _breached(t, name):
    df = getattr(t, name).withColumn("r", F.col(KEYS[name]) % 25)
    types = dict(df.dtypes)
    cols = [c for c in df.columns if c != "r"]
    return df.select(*[F.expr(BREACHES[name][c]).cast(types[c]).alias(c) if c in BREACHES[name]
                       else F.col(c) for c in cols])


def _tables(t):
    return {n: _breached(t, n) for n in SCHEMAS}


_BREACH_SQL = "".join(f""",
x_{n} AS (SELECT {", ".join(f"{e} AS {c}" for c, e in cols.items())}
          FROM (SELECT *, {KEYS[n]} % 25 AS r FROM {n}))""" for n, cols in BREACHES.items())


def _counts(table: str, rules: str) -> str:
    """One row per ``rule = violation condition`` line of ``rules``."""
    pairs = [line.split(" = ", 1) for line in rules.strip().splitlines()]
    return "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, '{rule.strip().replace(chr(39), chr(39) * 2)}' AS rule, "
        f"CAST(count_if({cond}) AS BIGINT) AS violations FROM x_{table}" for rule, cond in pairs)


def _nulls(table: str, columns: str) -> str:
    return _counts(table, "\n".join(f"not_null:{c} = {c} IS NULL" for c in columns.split()))


# NOT NULL columns, by hand from the schema
_NOT_NULL_SQL = "\nUNION ALL\n".join([
    _nulls("suppliers", "supplier_id name phone"),
    _nulls("ingredients", "ingredient_id name unit quantity reorder_level unit_price"),
    _nulls("purchases", "purchase_id supplier_id ingredient_id quantity cost purchase_date"),
    _nulls("menu_items", "menu_id name category price discount is_available"),
    _nulls("recipes", "menu_id ingredient_id qty_required"),
    _nulls("customers", "customer_id name phone"),
    _nulls("employees", "employee_id name role phone salary hire_date"),
    _nulls("orders", "order_id employee_id order_date status total_amount"),
    _nulls("order_items", "order_item_id order_id menu_id quantity price"),
    _nulls("users", "user_id username password role")])

_CHECK_SQL = "\nUNION ALL\n".join([
    _counts("ingredients", """check:quantity >= 0 = quantity < 0
check:unit_price >= 0 = unit_price < 0"""),
    _counts("purchases", "check:quantity > 0 = quantity <= 0"),
    _counts("menu_items", """check:price > 0 = price <= 0
check:discount >= 0 AND discount <= 100 = discount < 0 OR discount > 100"""),
    _counts("orders", "check:status IN ('Pending', 'Served', 'Paid', 'Cancelled') = "
                      "status NOT IN ('Pending', 'Served', 'Paid', 'Cancelled')"),
    _counts("order_items", "check:quantity > 0 = quantity <= 0"),
    _counts("users", "check:role IN ('admin', 'customer') = role NOT IN ('admin', 'customer')")])

_LENGTH_SQL = "\nUNION ALL\n".join([
    _counts("suppliers", """length:name<=100 = length(name) > 100
length:phone<=20 = length(phone) > 20
length:email<=100 = length(email) > 100
length:address<=150 = length(address) > 150"""),
    _counts("ingredients", """length:name<=100 = length(name) > 100
length:unit<=10 = length(unit) > 10"""),
    _counts("menu_items", """length:name<=100 = length(name) > 100
length:category<=30 = length(category) > 30"""),
    _counts("customers", """length:name<=100 = length(name) > 100
length:phone<=20 = length(phone) > 20"""),
    _counts("employees", """length:name<=100 = length(name) > 100
length:role<=30 = length(role) > 30
length:phone<=20 = length(phone) > 20"""),
    _counts("orders", "length:status<=20 = length(status) > 20"),
    _counts("users", """length:username<=50 = length(username) > 50
length:password<=255 = length(password) > 255
length:role<=10 = length(role) > 10""")])


def _unique(table: str, *columns: str) -> str:
    key = ", ".join(columns)
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return (f"SELECT '{table}' AS table_name, 'unique:{','.join(columns)}' AS rule, "
            f"CAST(count(*) AS BIGINT) AS violations FROM (SELECT {key} FROM x_{table} "
            f"WHERE {known} GROUP BY {key} HAVING count(*) > 1)")


_UNIQUE_SQL = "\nUNION ALL\n".join([
    _unique("suppliers", "supplier_id"), _unique("suppliers", "phone"), _unique("suppliers", "email"),
    _unique("ingredients", "ingredient_id"), _unique("ingredients", "name"),
    _unique("purchases", "purchase_id"), _unique("menu_items", "menu_id"),
    _unique("menu_items", "name"), _unique("recipes", "menu_id", "ingredient_id"),
    _unique("customers", "customer_id"), _unique("customers", "phone"),
    _unique("employees", "employee_id"), _unique("employees", "phone"),
    _unique("orders", "order_id"), _unique("order_items", "order_item_id"),
    _unique("users", "user_id"), _unique("users", "username")])


def _dangling(child: str, col: str, parent: str, parent_col: str) -> str:
    return (f"SELECT '{child}' AS table_name, 'fk:{col}->{parent}.{parent_col}' AS rule, "
            f"CAST(count(*) AS BIGINT) AS violations FROM x_{child} c WHERE c.{col} IS NOT NULL "
            f"AND NOT EXISTS (SELECT 1 FROM x_{parent} p WHERE p.{parent_col} = c.{col})")


_FK_SQL = "\nUNION ALL\n".join([
    _dangling("ingredients", "supplier_id", "suppliers", "supplier_id"),
    _dangling("purchases", "supplier_id", "suppliers", "supplier_id"),
    _dangling("purchases", "ingredient_id", "ingredients", "ingredient_id"),
    _dangling("recipes", "menu_id", "menu_items", "menu_id"),
    _dangling("recipes", "ingredient_id", "ingredients", "ingredient_id"),
    _dangling("orders", "customer_id", "customers", "customer_id"),
    _dangling("orders", "employee_id", "employees", "employee_id"),
    _dangling("order_items", "order_id", "orders", "order_id"),
    _dangling("order_items", "menu_id", "menu_items", "menu_id"),
    _dangling("users", "customer_id", "customers", "customer_id")])


@register("dq_not_null", _NOT_NULL_SQL, extra_ctes=_BREACH_SQL)
def _dq_not_null(t):
    return Q.summary(_tables(t), "not_null")


@register("dq_unique", _UNIQUE_SQL, extra_ctes=_BREACH_SQL)
def _dq_unique(t):
    return Q.summary(_tables(t), "unique")


@register("dq_check", _CHECK_SQL, extra_ctes=_BREACH_SQL)
def _dq_check(t):
    return Q.summary(_tables(t), "check")


@register("dq_foreign_key", _FK_SQL, extra_ctes=_BREACH_SQL)
def _dq_foreign_key(t):
    return Q.summary(_tables(t), "fk")


@register("dq_length", _LENGTH_SQL, extra_ctes=_BREACH_SQL)
def _dq_length(t):
    return Q.summary(_tables(t), "length")


@register("dq_violations", f"""
SELECT table_name, rule, sum(violations) AS n FROM (
{_NOT_NULL_SQL}
UNION ALL
{_CHECK_SQL}
UNION ALL
{_LENGTH_SQL}
UNION ALL
{_UNIQUE_SQL}
UNION ALL
{_FK_SQL}
) GROUP BY 1, 2 HAVING sum(violations) > 0""", extra_ctes=_BREACH_SQL)
def _dq_violations(t):
    """The detail rows of every rule, counted per rule (keys of duplicated values once).  The tables are
    written once: the audit reads them three times, and the ids of lines and purchases take a sort each."""
    tables = {name: stored(df, f"audit-{name}") for name, df in _tables(t).items()}
    return Q.all_violations(tables).groupBy("table_name", "rule").agg(
        F.count(F.lit(1)).alias("n"))


@register("dq_form_rules", """
SELECT seq, op,
       CASE WHEN op = 'add' AND length(trim(coalesce(name, ''))) = 0 THEN 'name is empty'
            WHEN NOT coalesce(price > 0, false) THEN 'price must be above 0'
            WHEN NOT coalesce(discount >= 0 AND discount <= 100, false)
              THEN 'discount must be 0..100' END AS reason
FROM menu_changes WHERE op IN ('add', 'update')""")
def _dq_form_rules(t):
    c = t.menu_changes
    adds = Q.with_reason(c.filter(F.col("op") == "add"), Q.menu_form_rules())
    ups = Q.with_reason(c.filter(F.col("op") == "update"), Q.menu_update_rules())
    return adds.unionByName(ups).select("seq", "op", "reason")
