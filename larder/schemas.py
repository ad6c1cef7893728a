"""Declared schemas of the ten restaurant tables.

Ids are LongType (generated ids outgrow INT at scale); money and stock are
DecimalType(10,2), discount DecimalType(5,2), never double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
PERCENT = T.DecimalType(5, 2)


def _s(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


L, S, I = T.LongType(), T.StringType(), T.IntegerType()

SCHEMAS: dict[str, T.StructType] = {
    "suppliers": _s(("supplier_id", L, False), ("name", S, False), ("phone", S, False),
                    ("email", S, True), ("address", S, True)),
    "ingredients": _s(("ingredient_id", L, False), ("name", S, False), ("unit", S, False),
                      ("quantity", MONEY, False), ("reorder_level", MONEY, False),
                      ("unit_price", MONEY, False), ("supplier_id", L, True)),
    "purchases": _s(("purchase_id", L, False), ("supplier_id", L, False),
                    ("ingredient_id", L, False), ("quantity", MONEY, False),
                    ("cost", MONEY, False), ("purchase_date", T.DateType(), False)),
    "menu_items": _s(("menu_id", L, False), ("name", S, False), ("category", S, False),
                     ("price", MONEY, False), ("discount", PERCENT, False),
                     ("is_available", I, False)),
    "recipes": _s(("menu_id", L, False), ("ingredient_id", L, False),
                  ("qty_required", MONEY, False)),
    "customers": _s(("customer_id", L, False), ("name", S, False), ("phone", S, False)),
    "employees": _s(("employee_id", L, False), ("name", S, False), ("role", S, False),
                    ("phone", S, False), ("salary", MONEY, False),
                    ("hire_date", T.DateType(), False)),
    "orders": _s(("order_id", L, False), ("customer_id", L, True), ("employee_id", L, False),
                 ("order_date", T.TimestampNTZType(), False), ("status", S, False),
                 ("total_amount", MONEY, False)),
    "order_items": _s(("order_item_id", L, False), ("order_id", L, False),
                      ("menu_id", L, False), ("quantity", I, False), ("price", MONEY, False)),
    "users": _s(("user_id", L, False), ("username", S, False), ("password", S, False),
                ("role", S, False), ("customer_id", L, True)),
}

# Column defaults of the declared tables (used by seed loads and inserts).
DEFAULTS: dict[str, dict[str, object]] = {
    "ingredients": {"quantity": 0, "reorder_level": 5},
    "menu_items": {"discount": 0, "is_available": 1},
    "orders": {"status": "Pending", "total_amount": 0},
}

# Fixed values of the reference schema: allowed order statuses, user roles,
# and VARCHAR lengths (checked by the data-quality jobs).
ORDER_STATUSES = ["Pending", "Served", "Paid", "Cancelled"]
USER_ROLES = ["admin", "customer"]
VARCHAR_LIMITS: dict[str, dict[str, int]] = {
    "suppliers": {"name": 100, "phone": 20, "email": 100, "address": 150},
    "ingredients": {"name": 100, "unit": 10},
    "menu_items": {"name": 100, "category": 30},
    "customers": {"name": 100, "phone": 20},
    "employees": {"name": 100, "role": 30, "phone": 20},
    "orders": {"status": 20},
    "users": {"username": 50, "password": 255, "role": 10},
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast ``df``'s columns to the declared schema of ``table``.

    Missing columns with a declared default get it; other missing columns are
    NULL.  ANSI casts raise on values that do not fit (e.g. decimal overflow).
    """
    schema = SCHEMAS[table]
    defaults = DEFAULTS.get(table, {})
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name)
        elif f.name in defaults:
            c = F.lit(defaults[f.name])
        else:
            c = F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)
