from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from larder.session import build_session  # noqa: E402
from larder.sources.catalog import load_rows  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="larder-tests", shuffle_partitions=4, extra={
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="larder-test-ckpt-"),
        "spark.driver.memory": "4g",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s


def d(x) -> Decimal:
    return Decimal(str(x))


# Seed rows of the reference's sample database (fixed values).  Names and
# phones of people and companies are invented; amounts, quantities, prices,
# dates and keys are the reference's.
SUPPLIERS = [
    (1, "Supplier 1", "0100000001", "farm@example.com", "North"),
    (2, "Supplier 2", "0100000002", "meat@example.com", "West"),
    (3, "Supplier 3", "0100000003", "dairy@example.com", "East"),
    (4, "Supplier 4", "0100000004", None, "Old Town"),
]
INGREDIENTS = [
    (1, "Rice", "kg", 50, 20, 75, 1), (2, "Chicken", "kg", 12, 15, 280, 2),
    (3, "Beef", "kg", 8, 10, 750, 2), (4, "Potato", "kg", 30, 10, 40, 1),
    (5, "Onion", "kg", 25, 10, 60, 1), (6, "Oil", "litre", 18, 8, 165, 4),
    (7, "Milk", "litre", 5, 10, 90, 3), (8, "Cheese", "kg", 3, 4, 850, 3),
    (9, "Flour", "kg", 22, 10, 55, 1), (10, "Spice Mix", "kg", 4, 3, 320, 4),
]
PURCHASES = [
    (1, 1, 1, 50, 3750, "2026-07-01"), (2, 2, 2, 20, 5600, "2026-07-03"),
    (3, 2, 3, 15, 11250, "2026-07-03"), (4, 1, 4, 30, 1200, "2026-07-05"),
    (5, 3, 7, 20, 1800, "2026-07-06"), (6, 4, 6, 25, 4125, "2026-07-10"),
    (7, 1, 5, 25, 1500, "2026-07-12"), (8, 3, 8, 10, 8500, "2026-07-15"),
]
MENU = [
    (1, "Chicken Biryani", "Main", 280, 10, 1), (2, "Beef Curry", "Main", 350, 0, 1),
    (3, "Plain Rice", "Main", 60, 0, 1), (4, "French Fries", "Snacks", 120, 0, 1),
    (5, "Cheese Burger", "Snacks", 250, 20, 1), (6, "Milk Tea", "Drinks", 40, 0, 1),
    (7, "Cold Coffee", "Drinks", 110, 0, 0),
]
RECIPES = [
    (1, 1, 0.25), (1, 2, 0.30), (1, 6, 0.05), (1, 10, 0.02),
    (2, 3, 0.30), (2, 5, 0.10), (2, 6, 0.05), (2, 10, 0.02),
    (3, 1, 0.20),
    (4, 4, 0.30), (4, 6, 0.08),
    (5, 9, 0.15), (5, 2, 0.15), (5, 8, 0.05),
    (6, 7, 0.15),
]
CUSTOMERS = [(1, "Customer A", "0200000001"), (2, "Customer B", "0200000002"),
             (3, "Customer C", "0200000003"), (4, "Customer D", "0200000004")]
EMPLOYEES = [
    (1, "Staff A", "Manager", "0300000001", 45000, "2024-01-10"),
    (2, "Staff B", "Chef", "0300000002", 35000, "2024-03-15"),
    (3, "Staff C", "Waiter", "0300000003", 18000, "2025-01-05"),
    (4, "Staff D", "Waiter", "0300000004", 18000, "2025-06-20"),
    (5, "Staff E", "Cashier", "0300000005", 22000, "2025-09-01"),
]
ORDERS = [
    (1, 1, 3, "2026-08-01 13:20:00", "Paid", 600), (2, 2, 3, "2026-08-01 19:45:00", "Paid", 350),
    (3, None, 4, "2026-08-02 12:10:00", "Paid", 370), (4, 3, 4, "2026-08-02 20:05:00", "Paid", 840),
    (5, 1, 5, "2026-08-03 14:30:00", "Served", 280),
    (6, 4, 3, "2026-08-03 21:00:00", "Cancelled", 0),
]
ORDER_ITEMS = [(1, 1, 1, 2, 280), (2, 1, 6, 1, 40), (3, 2, 2, 1, 350), (4, 3, 5, 1, 250),
               (5, 3, 4, 1, 120), (6, 4, 1, 3, 280), (7, 5, 1, 1, 280)]


def _date(s):
    return dt.date.fromisoformat(s)


def _ts(s):
    return dt.datetime.fromisoformat(s)


def seed_rows() -> dict[str, list[dict]]:
    import hashlib
    h = lambda p: hashlib.sha256(p.encode()).hexdigest()
    return {
        "suppliers": [dict(zip(["supplier_id", "name", "phone", "email", "address"], r))
                      for r in SUPPLIERS],
        "ingredients": [dict(ingredient_id=i, name=n, unit=u, quantity=d(q), reorder_level=d(r),
                             unit_price=d(p), supplier_id=s) for i, n, u, q, r, p, s in INGREDIENTS],
        "purchases": [dict(purchase_id=i, supplier_id=s, ingredient_id=g, quantity=d(q), cost=d(c),
                           purchase_date=_date(t)) for i, s, g, q, c, t in PURCHASES],
        "menu_items": [dict(menu_id=i, name=n, category=c, price=d(p), discount=d(x), is_available=a)
                       for i, n, c, p, x, a in MENU],
        "recipes": [dict(menu_id=m, ingredient_id=i, qty_required=d(q)) for m, i, q in RECIPES],
        "customers": [dict(customer_id=i, name=n, phone=p) for i, n, p in CUSTOMERS],
        "employees": [dict(employee_id=i, name=n, role=r, phone=p, salary=d(s), hire_date=_date(h_))
                      for i, n, r, p, s, h_ in EMPLOYEES],
        "orders": [dict(order_id=i, customer_id=c, employee_id=e, order_date=_ts(t), status=s,
                        total_amount=d(a)) for i, c, e, t, s, a in ORDERS],
        "order_items": [dict(order_item_id=i, order_id=o, menu_id=m, quantity=q, price=d(p))
                        for i, o, m, q, p in ORDER_ITEMS],
        "users": [dict(user_id=1, username="admin", password=h("admin123"), role="admin",
                       customer_id=None),
                  dict(user_id=2, username="ana", password=h("1234"), role="customer",
                       customer_id=1),
                  dict(user_id=3, username="ben", password=h("1234"), role="customer",
                       customer_id=2),
                  dict(user_id=4, username="cara", password=h("1234"), role="customer",
                       customer_id=3)],
    }


@pytest.fixture(scope="session")
def seed(spark):
    return {t: load_rows(spark, t, rows).cache() for t, rows in seed_rows().items()}


def rows(df, *cols):
    """Collected rows as tuples (optionally of selected columns), in order."""
    if cols:
        df = df.select(*cols)
    return [tuple(r) for r in df.collect()]
