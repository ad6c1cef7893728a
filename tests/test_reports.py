"""Goldens of the reference's documented queries and panel reports on the
seed fixture (expected values re-derived by hand from the seed rows)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from larder.functions import exprs as X
from larder.operators import aggregates as A
from larder.operators import filters as P
from larder.operators import joins as J
from larder.sources import catalog
from tests.conftest import d, rows


def test_q1_scan_all(seed):
    assert P.scan_all(seed["menu_items"]).count() == 7


def test_q1b_discounted_final_price(seed):
    got = rows(P.discounted_items(seed["menu_items"]), "name", "final_price", "you_save")
    assert got == [("Cheese Burger", d("200.00"), d("50.00")),
                   ("Chicken Biryani", d("252.00"), d("28.00"))]


def test_q2_filter_and_sort(seed):
    got = rows(P.filter_and_eq(seed["menu_items"], "Main"), "name", "price")
    assert got == [("Plain Rice", d(60)), ("Chicken Biryani", d(280)), ("Beef Curry", d(350))]


def test_final_price_rounding(spark):
    df = spark.createDataFrame([(Decimal("99.99"), Decimal("12.50"))],
                               "price decimal(10,2), discount decimal(5,2)")
    assert df.select(X.final_price()).first()[0] == d("87.49")


def test_q6_inner_join_drops_nothing_in_seed(seed):
    assert J.join_inner(seed["ingredients"], seed["suppliers"]).count() == 10


def test_q7_left_join_count(seed):
    got = sorted(rows(J.join_left_count(seed["customers"], seed["orders"]), "customer_id",
                      "total_orders"))
    assert got == [(1, 2), (2, 1), (3, 1), (4, 1)]


def test_q8_bill_of_one_order(spark, seed):
    ids = spark.createDataFrame([(1,)], "order_id long")
    b = J.order_bill_4way(seed["orders"], seed["customers"], seed["order_items"],
                          seed["menu_items"], ids)
    got = sorted(rows(b, "item", "quantity", "subtotal"))
    assert got == [("Chicken Biryani", 2, d("560.00")), ("Milk Tea", 1, d("40.00"))]
    assert sum(r[2] for r in got) == d("600.00")


def test_q8_walk_in_dropped_by_inner_join(seed):
    b = J.order_bill_4way(seed["orders"], seed["customers"], seed["order_items"],
                          seed["menu_items"])
    assert 3 not in {r[0] for r in rows(b, "order_id")}


def test_q9_low_stock_inclusive(seed):
    got = {r[0] for r in rows(P.low_stock(seed["ingredients"]), "name")}
    assert got == {"Chicken", "Beef", "Milk", "Cheese"}


def test_low_stock_tie_counts(spark):
    from larder.sources.catalog import load_rows
    ing = load_rows(spark, "ingredients", [dict(ingredient_id=1, name="x", unit="kg",
                                                quantity=d(5), reorder_level=d(5),
                                                unit_price=d(1))])
    assert P.low_stock(ing).count() == 1


def test_q10_daily_sales(seed):
    got = rows(A.daily_sales(seed["orders"]), "day", "total_orders", "total_sales")
    assert [(str(a), b, c) for a, b, c in got] == [("2026-08-01", 2, d("950.00")),
                                                  ("2026-08-02", 2, d("1210.00"))]


def test_q11_best_sellers_ties_by_key(seed):
    got = rows(A.best_sellers(seed["order_items"], seed["menu_items"]), "name", "sold")
    assert got[0] == ("Chicken Biryani", 6)
    assert [r[1] for r in got[1:]] == [1, 1, 1, 1]
    assert [r[0] for r in got[1:]] == ["Beef Curry", "French Fries", "Cheese Burger", "Milk Tea"]


def test_q12_having(seed):
    got = rows(A.supplier_cost_having(seed["suppliers"], seed["purchases"], 5000), "total_cost")
    assert [r[0] for r in got] == [d(16850), d(10300), d(6450)]


def test_q13_scalar_subquery(seed):
    got = [r[0] for r in rows(P.scalar_subquery(seed["menu_items"]), "name")]
    assert got == ["Beef Curry", "Chicken Biryani", "Cheese Burger"]


def test_q14_employee_sales(seed):
    got = rows(A.employee_sales(seed["employees"], seed["orders"]), "employee_id",
               "orders_handled", "sales")
    assert got == [(4, 2, d(1210)), (3, 3, d(950)), (5, 1, d(280)), (1, 0, d(0)), (2, 0, d(0))]


def test_q15_stock_value(seed):
    got = rows(P.stock_value(seed["ingredients"]), "stock_value")
    assert len(got) == 10 and sum(r[0] for r in got) == d(24270)


def test_dashboard_kpis(seed):
    r = A.dashboard_kpis(seed["menu_items"], seed["orders"], seed["ingredients"]).first()
    assert (r.total_food, r.offer_count, r.total_orders, r.total_sales, r.stock_value,
            r.low_count) == (7, 2, 6, d(2160), d(24270), 4)


def test_best_sellers_revenue_by_name(seed):
    got = rows(A.best_sellers_revenue(seed["order_items"], seed["menu_items"]))
    assert got[0] == ("Chicken Biryani", 6, d(1680))
    assert sorted(got[1:]) == sorted([("Beef Curry", 1, d(350)), ("Cheese Burger", 1, d(250)),
                                      ("French Fries", 1, d(120)), ("Milk Tea", 1, d(40))])


def test_customer_spend_having_alias(seed):
    got = rows(A.customer_spend(seed["customers"], seed["orders"]), "name", "orders", "total_spent")
    assert got == [("Customer A", 2, d(880)), ("Customer C", 1, d(840)), ("Customer B", 1, d(350))]


def test_namesakes_merge_by_name_but_not_by_id(spark, seed):
    from larder.sources.catalog import load_rows
    cust = seed["customers"].unionByName(
        load_rows(spark, "customers", [dict(customer_id=9, name="Customer A", phone="x")]))
    orders = seed["orders"].unionByName(load_rows(spark, "orders", [dict(
        order_id=9, customer_id=9, employee_id=3, order_date=None, status="Paid",
        total_amount=d(20))]).fillna({"order_date": "2026-08-04"}))
    by_name = dict(rows(A.customer_spend(cust, orders), "name", "total_spent"))
    assert by_name["Customer A"] == d(900)
    by_id = dict(rows(J.join_left_count(cust, orders), "customer_id", "total_orders"))
    assert by_id[1] == 2 and by_id[9] == 1


def test_supplier_purchases_keeps_zero(spark, seed):
    from larder.sources.catalog import load_rows
    sup = seed["suppliers"].unionByName(load_rows(spark, "suppliers", [dict(
        supplier_id=5, name="Idle Ltd", phone="p5")]))
    got = dict((r[0], (r[1], r[2])) for r in rows(A.supplier_purchases(sup, seed["purchases"])))
    assert got["Supplier 2"] == (2, d(16850)) and got["Supplier 3"] == (2, d(10300))
    assert got["Supplier 1"] == (3, d(6450)) and got["Supplier 4"] == (1, d(4125))
    assert got["Idle Ltd"] == (0, d(0))


def test_stock_totals(seed):
    r = A.stock_totals(seed["ingredients"]).first()
    assert (r.items, r.stock_value, r.avg_unit_price) == (10, d(24270), d("268.50"))


def test_recipe_report(seed):
    got = rows(J.recipe_report(seed["recipes"], seed["menu_items"], seed["ingredients"]))
    assert len(got) == 15 and got[0][0] == "Beef Curry"


def test_recent_orders_walk_in(seed):
    got = rows(J.recent_orders(seed["orders"], seed["customers"], seed["employees"], 6),
               "order_id", "customer")
    assert [r[0] for r in got] == [6, 5, 4, 3, 2, 1]
    assert dict(got)[3] == "Walk-in"


def test_order_listing_item_counts_and_filter(seed):
    got = dict(rows(J.order_listing(seed["orders"], seed["customers"], seed["employees"],
                                    seed["order_items"]), "order_id", "items"))
    assert got == {1: 2, 2: 1, 3: 2, 4: 1, 5: 1, 6: 0}
    paid = J.order_listing(seed["orders"], seed["customers"], seed["employees"],
                           seed["order_items"], status="Paid")
    assert paid.count() == 4
    assert J.order_listing(seed["orders"], seed["customers"], seed["employees"],
                           seed["order_items"], status="bogus").count() == 6


def test_inventory_search_wildcards_and_status(seed):
    ing = seed["ingredients"]
    cond = P.stock_status_condition("i", "low")
    assert {r[0] for r in rows(J.inventory_list(ing, seed["suppliers"], cond), "name")} == \
        {"Chicken", "Milk"}
    # '_' typed by a user is a wildcard
    assert {r[0] for r in rows(ing.filter(X.like_contains("name", "_eef")), "name")} == {"Beef"}
    first = rows(J.inventory_list(ing, seed["suppliers"]), "name")[0][0]
    assert first == "Beef"  # low items first, then by name


def test_login_audit(spark, seed):
    att = spark.createDataFrame([(1, " ana ", "1234"), (2, "ana", "bad"), (3, "zed", "1234"),
                                 (4, "admin", "admin123")], "seq long, username string, password string")
    got = rows(J.login_audit(att, seed["users"]).orderBy("seq"), "seq", "ok", "role")
    assert got == [(1, True, "customer"), (2, False, None), (3, False, None), (4, True, "admin")]


def test_account_directory_display_name(seed):
    got = dict(rows(J.account_directory(seed["users"], seed["customers"]), "username",
                    "display_name"))
    assert got["admin"] == "admin" and got["ana"] == "Customer A"


def test_menu_by_category(seed):
    got = sorted((r["category"], r["position"], r["name"])
                 for r in A.menu_by_category(seed["menu_items"]).collect())
    assert got == [("Drinks", 1, "Milk Tea"), ("Main", 1, "Beef Curry"),
                   ("Main", 2, "Chicken Biryani"), ("Main", 3, "Plain Rice"),
                   ("Snacks", 1, "Cheese Burger"), ("Snacks", 2, "French Fries")]


def test_bill_with_total(seed):
    b = A.bill_with_total(seed["order_items"], seed["menu_items"]).filter("order_id = 1")
    tot = [r for r in rows(b, "row_kind", "subtotal") if r[0] == "total"]
    assert tot == [("total", d(600))]


def test_cart_totals_and_count(spark, seed):
    carts = spark.createDataFrame(
        [(1, {1: ("Chicken Biryani", 2), 5: ("Cheese Burger", 1), 99: ("gone", 3)})],
        "cart_id long, cart map<long, struct<name string, qty int>>")
    r = A.cart_totals(carts, seed["menu_items"]).first()
    assert (r.grand, r.saved) == (d(704), d(106))  # 2*252 + 200, 2*28 + 50
    assert A.cart_count(carts).first().cart_count == 6


def test_order_reconcile_seed_is_zero(seed):
    diffs = rows(A.order_reconcile(seed["orders"], seed["order_items"]), "difference")
    assert all(r[0] == 0 for r in diffs)


def test_first_waiter(seed, spark):
    assert P.first_waiter(seed["employees"]).first().employee_id == 3
    no_waiter = seed["employees"].filter(F.col("role") != "Waiter")
    assert P.first_waiter(no_waiter).first().employee_id == 1


def test_views_registered(spark, seed):
    catalog.register_views(spark, seed)
    assert {r[0] for r in rows(spark.table("v_low_stock"), "name")} == \
        {"Chicken", "Beef", "Milk", "Cheese"}
    assert spark.table("v_daily_sales").count() == 2


def test_scalar_text_functions(spark):
    df = spark.createDataFrame([(Decimal("1234.50"), Decimal("10.00"), "3.7"),
                                (Decimal("5.00"), Decimal("12.50"), "x")],
                               "a decimal(10,2), p decimal(5,2), t string")
    got = rows(df.select(X.money_text("a"), X.percent_text("p"), X.tolerant_int("t", 1),
                         X.tolerant_number("t", 0.0)))
    assert got == [("1,234.50", "10", 3, 3.7), ("5.00", "12.5", 1, 0.0)]


def test_ingredient_without_supplier_kept_by_left_joins(spark, seed):
    from larder.sources.catalog import load_rows
    ing = seed["ingredients"].unionByName(load_rows(spark, "ingredients", [dict(
        ingredient_id=11, name="Salt", unit="kg", quantity=d(1), reorder_level=d(2),
        unit_price=d(20))]))
    inv = {r.name: r.supplier for r in J.inventory_list(ing, seed["suppliers"]).collect()}
    assert "Salt" in inv and inv["Salt"] is None
    low = {r.name: r.supplier for r in J.low_stock_supplier(ing, seed["suppliers"]).collect()}
    assert low["Salt"] is None
    assert "Salt" not in {r.ingredient for r in J.join_inner(ing, seed["suppliers"]).collect()}


def test_parameterised_variants(spark, seed):
    me = spark.createDataFrame([(1,)], "customer_id long")
    mine = rows(A.my_orders(seed["orders"], seed["order_items"], me), "order_id", "items")
    assert mine == [(5, 1), (1, 2)]  # newest first
    assert P.key_param_filter(seed["order_items"], "order_id", 1).count() == 2
    req = spark.createDataFrame([(1, 1), (2, 1), (4, 3)], "order_id long, customer_id long")
    bill = rows(J.owner_bill(seed["order_items"], seed["menu_items"], seed["orders"], req),
                "order_id", "name")
    assert sorted(bill) == [(1, "Chicken Biryani"), (1, "Milk Tea"), (4, "Chicken Biryani")]
    admin = P.menu_listing(seed["menu_items"], admin=True)
    assert admin.count() == 7 and "is_available" in admin.columns
    assert P.menu_listing(seed["menu_items"]).count() == 6
