"""Change jobs (U1-U11, W3) and data-quality audits."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from larder.operators import changes as U
from larder.operators import quality as Q
from larder.operators import windows as W
from larder.sources.catalog import load_rows
from tests.conftest import d, rows


def _menu_changes(spark, data):
    return spark.createDataFrame(data, "seq long, op string, menu_id long, name string, "
                                       "category string, price decimal(10,2), "
                                       "discount decimal(5,2), is_available int")


def test_menu_insert_rules(spark, seed):
    ch = _menu_changes(spark, [
        (1, "add", None, " Vegetable Soup ", "Snacks", d(90), d(0), None),
        (2, "add", None, "Vegetable Soup", "Snacks", d(95), d(0), None),   # duplicate in batch
        (3, "add", None, "Beef Curry", "Main", d(100), d(0), None),        # exists
        (4, "add", None, "  ", "Main", d(10), d(0), None),                 # blank
        (5, "add", None, "Lassi", "Drinks", d(0), d(0), None),             # price
        (6, "add", None, "Pie", "Snacks", d(10), d(101), None),            # discount
        (7, "add", None, "Pie", "Snacks", d(10), d(5), None),              # valid after invalid
    ])
    table, out = U.menu_insert(seed["menu_items"], ch)
    got = {r.seq: (r.menu_id, r.reason) for r in out.collect()}
    assert got == {1: (8, None), 2: (None, "duplicate name in batch"), 3: (None, "name exists"),
                   4: (None, "name is empty"), 5: (None, "price must be above 0"),
                   6: (None, "discount must be 0..100"), 7: (9, None)}
    new = {r.name: (r.menu_id, r.is_available) for r in table.filter("menu_id > 7").collect()}
    assert new == {"Vegetable Soup": (8, 1), "Pie": (9, 1)}


def test_menu_update_last_wins_and_unticked(spark, seed):
    ch = _menu_changes(spark, [
        (1, "update", 1, None, None, d(300), d(25), 1),
        (2, "update", 1, None, None, d(310), d(5), None),   # unticked -> 0, later wins
        (3, "update", 2, None, None, d(-1), d(0), 1),       # invalid, ignored
        (4, "update", 99, None, None, d(5), d(0), 1),       # unknown id
    ])
    got = {r.menu_id: (r.price, r.discount, r.is_available)
           for r in U.menu_update(seed["menu_items"], ch).collect()}
    assert got[1] == (d(310), d(5), 0) and got[2] == (d(350), d(0), 1) and 99 not in got


def test_q4_category_price_up(seed):
    got = {r.name: r.price for r in U.category_price_up(seed["menu_items"], "Drinks").collect()}
    assert got["Milk Tea"] == d("44.00") and got["Cold Coffee"] == d("121.00")
    assert got["Beef Curry"] == d(350)


def test_menu_delete_requests_and_statement(spark, seed):
    req = spark.createDataFrame([(1, 7), (2, 1), (3, 42), (4, 7)], "seq long, menu_id long")
    menu, rec, out = U.menu_delete(seed["menu_items"], seed["recipes"], seed["order_items"], req)
    assert dict(rows(out, "seq", "outcome")) == {1: "deleted", 2: "refused: sold before",
                                                3: "not found", 4: "not found"}
    assert menu.count() == 6 and rec.count() == 15  # Cold Coffee has no recipe
    # Q5: DELETE ... WHERE is_available = 0 touches only unsold Cold Coffee
    m2, _, blocked = U.menu_delete_where(seed["menu_items"], seed["recipes"], seed["order_items"],
                                         F.col("is_available") == 0)
    assert m2.count() == 6
    # a statement that also targets a sold item fails whole
    m3, r3, _ = U.menu_delete_where(seed["menu_items"], seed["recipes"], seed["order_items"],
                                    F.col("category") == "Drinks")
    assert m3.count() == 7 and r3.count() == 15


def test_ingredient_change(spark, seed):
    ch = spark.createDataFrame([
        (1, "add", None, "Salt", "kg", d(3), d(1), d(20), None),
        (2, "add", None, "Rice", "kg", d(3), d(1), d(20), 1),         # exists
        (3, "update", 2, None, None, d(40), d(15), d(290), None),
        (4, "update", 3, None, None, d(-1), d(10), d(750), None),     # negative: rejected
        (5, "delete", 1, None, None, None, None, None, None),         # used: refused
        (6, "add", None, "Sugar", "kg", d(2), d(1), d(10), 4),
        (7, "delete", 12, None, None, None, None, None, None),        # Sugar gets id 12
    ], "seq long, op string, ingredient_id long, name string, unit string, "
       "quantity decimal(10,2), reorder_level decimal(10,2), unit_price decimal(10,2), "
       "supplier_id long")
    table, out = U.ingredient_change(seed["ingredients"], seed["purchases"], seed["recipes"], ch)
    t = {r.ingredient_id: r for r in table.collect()}
    assert t[11].name == "Salt" and t[11].supplier_id is None
    assert 12 not in t                      # added then deleted (unused)
    assert t[2].quantity == d(40) and t[3].quantity == d(8)
    assert 1 in t
    reasons = {(r.seq): r.reason for r in out.collect()}
    assert reasons[2] == "name exists" and reasons[5].startswith("refused")
    assert reasons[4] == "quantity must be >= 0"


def test_deletes_cascade_set_null_restrict(spark, seed):
    gone = spark.createDataFrame([(1,)], "customer_id long")
    cust, users, orders = U.delete_customers(seed["customers"], seed["users"], seed["orders"], gone)
    assert cust.count() == 3 and {r.username for r in users.collect()} == {"admin", "ben", "cara"}
    assert {r.order_id for r in orders.collect() if r.customer_id is None} == {1, 3, 5}
    sup_req = spark.createDataFrame([(1,), (9,)], "supplier_id long")
    sup, ing, out = U.delete_suppliers(seed["suppliers"], seed["ingredients"], seed["purchases"],
                                       sup_req)
    assert dict(rows(out, "supplier_id", "outcome")) == {
        1: "refused: referenced by purchases", 9: "not found"}
    extra = load_rows(spark, "suppliers", [dict(supplier_id=5, name="Idle", phone="p")])
    ing2 = seed["ingredients"].unionByName(load_rows(spark, "ingredients", [dict(
        ingredient_id=11, name="Salt", unit="kg", unit_price=d(1), supplier_id=5)]))
    _, ing3, out2 = U.delete_suppliers(seed["suppliers"].unionByName(extra), ing2,
                                       seed["purchases"],
                                       spark.createDataFrame([(5,)], "supplier_id long"))
    assert rows(out2, "outcome") == [("deleted",)]
    assert {r.ingredient_id: r.supplier_id for r in ing3.collect()}[11] is None


def test_order_status_update(spark, seed):
    ch = spark.createDataFrame([(1, 5, "staff", None, "Paid"), (2, 5, "staff", None, "Done"),
                                (3, 6, "staff", None, "Pending")],
                               "seq long, order_id long, actor string, customer_id long, status string")
    got = dict(rows(U.order_status_update(seed["orders"], ch), "order_id", "status"))
    assert got[5] == "Paid" and got[6] == "Pending" and got[1] == "Paid"


def _serial_status(orders, changes, valid=("Pending", "Served", "Paid", "Cancelled")):
    status = {o: (s, c) for o, s, c in orders}
    changed = {}
    for seq, oid, actor, cid, st in sorted(changes):
        if oid not in status:
            if actor == "customer":
                changed[seq] = False
            continue
        cur, owner = status[oid]
        if actor == "staff":
            if st in valid:
                status[oid] = (st, owner)
        else:
            ok = st == "Cancelled" and cid is not None and cid == owner and cur == "Pending"
            if ok:
                status[oid] = ("Cancelled", owner)
            changed[seq] = ok
    return {o: s for o, (s, _) in status.items()}, changed


def test_status_fold_matches_serial_loop(spark):
    rnd = random.Random(11)
    orders = [(o, rnd.choice(["Pending", "Pending", "Served", "Paid"]), rnd.choice([1, 2, None]))
              for o in range(1, 40)]
    changes = []
    for seq in range(400):
        oid = 1 if rnd.random() < 0.3 else rnd.randrange(1, 42)   # order 1 is hot
        if rnd.random() < 0.4:
            changes.append((seq, oid, "staff", None, rnd.choice(["Pending", "Paid", "Done"])))
        else:
            changes.append((seq, oid, "customer", rnd.choice([1, 2]), "Cancelled"))
    o_df = load_rows(spark, "orders", [dict(order_id=o, customer_id=c, employee_id=1,
                                            order_date=None, status=s) for o, s, c in orders]) \
        .fillna({"order_date": "2026-01-01"})
    c_df = spark.createDataFrame(changes, "seq long, order_id long, actor string, "
                                          "customer_id long, status string")
    want_status, want_changed = _serial_status(orders, changes)
    for size in (8, None):
        got = dict(rows(W.status_fold(o_df, c_df, chunk_size=size), "order_id", "status"))
        assert got == want_status
        got_c = dict(rows(W.cancel_outcomes(o_df, c_df, chunk_size=size), "seq", "changed"))
        assert got_c == want_changed


def _serial_cart(events, available):
    cart = {}
    for cid, seq, op, m, q in sorted(events, key=lambda e: e[1]):
        key = (cid, m)
        if op == "add":
            if m in available:
                cart[key] = cart.get(key, 0) + max(1, q or 0)
        elif op == "set":
            if q is None or q <= 0:
                cart.pop(key, None)
            elif key in cart:
                cart[key] = q
        else:
            cart.pop(key, None)
    return cart


def test_cart_merge_matches_serial_loop(spark, seed):
    rnd = random.Random(5)
    ev = [(rnd.choice([1, 1, 1, 2]), s, rnd.choice(["add", "add", "set", "remove"]),
           rnd.choice([1, 6, 7, 42]), rnd.choice([None, -1, 0, 1, 3, 5])) for s in range(500)]
    df = spark.createDataFrame(ev, "cart_id long, seq long, op string, menu_id long, qty int")
    for n in (0, 100, 1 << 20):                  # every pair hot, some, none
        got = {(r.cart_id, r.menu_id): r.qty
               for r in U.cart_merge(df, seed["menu_items"], hot_rows=n).collect()}
        assert got == _serial_cart(ev, {1, 2, 3, 4, 5, 6})


# ---------------------------------------------------------------- audits

def test_clean_seed_has_no_violations(seed):
    assert Q.all_violations(seed).count() == 0
    s = Q.summary(seed, "not_null")
    assert s.count() > 30 and s.agg(F.sum("violations")).first()[0] == 0


def test_seeded_breaches(spark, seed):
    t = dict(seed)
    t["suppliers"] = seed["suppliers"].unionByName(load_rows(spark, "suppliers", [
        dict(supplier_id=5, name="Dup Phone", phone="0100000001", email=None),  # NULL email again
        dict(supplier_id=6, name="x" * 101, phone="0100000006")]))
    t["ingredients"] = seed["ingredients"].unionByName(load_rows(spark, "ingredients", [
        dict(ingredient_id=11, name="Salt", unit="kg", quantity=d(-1), unit_price=d(2),
             supplier_id=77)]))
    t["orders"] = seed["orders"].unionByName(load_rows(spark, "orders", [
        dict(order_id=7, customer_id=None, employee_id=3, order_date=None, status="Done")]))
    v = {(r.table_name, r.rule, r.key) for r in Q.all_violations(t).collect()}
    assert ("suppliers", "unique:phone", "0100000001") in v
    assert not any(r == "unique:email" for _, r, _ in v)
    assert ("suppliers", "length:name<=100", "6") in v
    assert ("ingredients", "check:quantity >= 0", "11") in v
    assert ("ingredients", "fk:supplier_id->suppliers.supplier_id", "11") in v
    assert ("orders", "not_null:order_date", "7") in v
    assert any(r.startswith("check:status IN") for tb, r, k in v if tb == "orders")


def test_form_reasons(spark):
    df = spark.createDataFrame([("", d(1), d(0)), ("a", d(0), d(0)), ("a", d(1), d(100)),
                                ("a", None, d(5))],
                               "name string, price decimal(10,2), discount decimal(5,2)")
    got = [r.reason for r in Q.with_reason(df, Q.menu_form_rules()).collect()]
    assert got == ["name is empty", "price must be above 0", None, "price must be above 0"]


def test_ingredient_change_follows_request_order(spark, seed):
    extra = load_rows(spark, "ingredients", [dict(ingredient_id=11, name="Salt", unit="kg",
                                                  unit_price=d(5))])  # used by nothing
    ing = seed["ingredients"].unionByName(extra)
    ch = spark.createDataFrame([
        (1, "add", None, "Salt", "kg", d(1), d(1), d(1), None),      # exists yet
        (2, "delete", 11, None, None, None, None, None, None),       # frees "Salt"
        (3, "add", None, "Salt", "kg", d(2), d(1), d(6), None),      # accepted -> id 12
        (4, "delete", 11, None, None, None, None, None, None),       # already gone
        (5, "update", 13, None, None, d(9), d(9), d(9), None),       # before 13 exists
        (6, "add", None, "Sugar", "kg", d(3), d(1), d(4), None),     # -> id 13
        (7, "delete", 12, None, None, None, None, None, None),       # new id, after its add
        (8, "update", 13, None, None, d(7), d(1), d(4), None),       # after the add
    ], "seq long, op string, ingredient_id long, name string, unit string, "
       "quantity decimal(10,2), reorder_level decimal(10,2), unit_price decimal(10,2), "
       "supplier_id long")
    table, out = U.ingredient_change(ing, seed["purchases"], seed["recipes"], ch)
    t = {r.ingredient_id: (r.name, r.quantity) for r in table.collect()}
    assert 11 not in t and 12 not in t and t[13] == ("Sugar", d(7))
    reasons = {r.seq: r.reason for r in out.collect()}
    assert reasons[1] == "name exists" and reasons[2] is None and reasons[3] is None
    assert reasons[4] == "not found" and reasons[7] is None


def test_apply_menu_changes_in_request_order(spark, seed):
    ch = _menu_changes(spark, [
        (1, "add", None, "Cold Coffee", "Drinks", d(100), d(0), None),   # name still taken
        (2, "delete", 7, None, None, None, None, None),                  # unsold: deleted
        (3, "add", None, "Cold Coffee", "Drinks", d(100), d(5), None),   # name free -> id 8
        (4, "update", 8, None, None, d(120), d(10), None),               # unticked -> 0
        (5, "delete", 1, None, None, None, None, None),                  # sold: refused
        (6, "delete", 7, None, None, None, None, None),                  # already gone
        (7, "update", 2, None, None, d(-5), d(0), 1),                    # invalid
    ])
    menu, rec, out = U.apply_menu_changes(seed["menu_items"], seed["recipes"],
                                          seed["order_items"], ch)
    m = {r.menu_id: (r.name, r.price, r.discount, r.is_available) for r in menu.collect()}
    assert 7 not in m and m[8] == ("Cold Coffee", d(120), d(10), 0) and 1 in m
    assert m[2][1] == d(350) and rec.count() == 15
    reasons = {r.seq: r.reason for r in out.collect()}
    assert reasons[1] == "name exists" and reasons[3] is None
    assert reasons[5] == "refused: sold before" and reasons[6] == "not found"
    assert reasons[7] == "price must be above 0"


def _serial_batch(names, requests, used=()):
    """Plain loop: names {id: name}; requests (seq, op, id, name)."""
    names, top, out = dict(names), max(names), {}
    for seq, op, i, name in sorted(requests):
        if op == "add":
            if not name.strip():
                out[seq] = "name is empty"
            elif name.strip() in names.values():
                out[seq] = "taken"
            else:
                top += 1
                names[top], out[seq] = name.strip(), None
        elif op == "delete":
            out[seq] = "not found" if i not in names else "refused" if i in used else None
            if out[seq] is None:
                del names[i]
    return names, out


def test_batches_equal_a_serial_loop(spark):
    """Random adds and deletes, names reused after deletes of rows that the batch
    itself added: table and outcomes equal a loop over the requests."""
    import random
    rnd = random.Random(11)
    start = {i: f"n{i}" for i in range(1, 6)}
    ing = load_rows(spark, "ingredients", [dict(ingredient_id=i, name=n, unit="kg", quantity=d(1), unit_price=d(1))
                                           for i, n in start.items()])
    none = spark.createDataFrame([], "ingredient_id long")
    used = spark.createDataFrame([(2,)], "ingredient_id long")
    cases = [[(1, "add", None, "x"), (2, "delete", 6, None), (3, "add", None, "x")],
             [(1, "add", None, "x"), (2, "delete", 6, None), (3, "add", None, "x"),
              (4, "delete", 7, None), (5, "add", None, "x"), (6, "add", None, "x")]]
    for _ in range(3):
        reqs = []
        for seq in range(1, 31):
            if rnd.random() < 0.55:
                reqs.append((seq, "add", None, rnd.choice(["a", "b", " a ", "n1", "n3", ""])))
            else:
                reqs.append((seq, "delete", rnd.randrange(1, 14), None))
        cases.append(reqs)
    for reqs in cases:
        ch = spark.createDataFrame(
            [(s, op, i, n, "kg", d(1), d(1), d(1), None) for s, op, i, n in reqs],
            "seq long, op string, ingredient_id long, name string, unit string, quantity decimal(10,2), "
            "reorder_level decimal(10,2), unit_price decimal(10,2), supplier_id long")
        table, out = U.ingredient_change(ing, used, none, ch)
        want, reasons = _serial_batch(start, reqs, used={2})
        assert {r.ingredient_id: r.name for r in table.collect()} == want
        short = {None: None, "name exists": "taken", "duplicate name in batch": "taken",
                 "refused: used by purchases": "refused"}
        assert {r.seq: short.get(r.reason, r.reason) for r in out.collect()} == reasons


def test_order_and_employee_deletes(spark, seed):
    gone = spark.createDataFrame([(1,)], "order_id long")
    orders, lines = U.delete_orders(seed["orders"], seed["order_items"], gone)
    assert orders.count() == 5 and lines.filter("order_id = 1").count() == 0
    reqs = spark.createDataFrame([(1,), (3,), (99,)], "employee_id long")
    left, out = U.delete_employees(seed["employees"], seed["orders"], reqs)
    assert {r.employee_id: r.outcome for r in out.collect()} == {
        1: "deleted", 3: "refused: referenced by orders", 99: "not found"}
    assert left.count() == 4


def _broken_tables(spark, seed):
    """The seed tables with breaches of every kind."""
    t = dict(seed)
    t["suppliers"] = t["suppliers"].unionByName(t["suppliers"].limit(1))
    t["recipes"] = t["recipes"].unionByName(spark.createDataFrame(
        [(1, 99, d(1)), (77, 1, d(1)), (None, 2, d(1))], t["recipes"].schema))
    t["orders"] = t["orders"].withColumn("status", F.when(F.col("order_id") == 2, F.lit("Done")).otherwise(F.col("status")))
    return t


def test_audit_reads_each_table_once(spark, seed):
    t = _broken_tables(spark, seed)
    v = {}
    for r in Q.all_violations(t).collect():
        v[r.table_name, r.rule] = v.get((r.table_name, r.rule), 0) + 1
    assert v[("suppliers", "unique:supplier_id")] == 1 and v[("suppliers", "unique:phone")] == 1
    assert v[("recipes", "fk:ingredient_id->ingredients.ingredient_id")] == 1
    assert v[("recipes", "fk:menu_id->menu_items.menu_id")] == 1 and v[("recipes", "not_null:menu_id")] == 1
    n = {}
    for kind in Q.KINDS:
        part = {(r.table_name, r.rule): r.violations for r in Q.summary(t, kind).collect()}
        assert set(part) == set(Q.rules_of(t, (kind,)))
        n |= {k: x for k, x in part.items() if x}
    assert n == v
    plan = Q.summary(t, "fk")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4


def test_append_checks_only_what_the_batch_touches(spark, seed, tmp_path):
    """New rows against stored tables: what the batch adds to the full audit."""
    new = spark.createDataFrame(
        [(1, 1, d(1)), (1, 99, d(1)), (2, 1, None), (55, 1, d(2)), (55, 1, d(3)), (None, None, d(1))],
        "menu_id long, ingredient_id long, qty_required decimal(10,2)")
    got = {(r.rule, r.key, r.detail) for r in Q.append_violations(new, "recipes", seed).collect()}
    after = {**seed, "recipes": seed["recipes"].unionByName(new)}
    want = {(r.rule, r.key, r.detail) for r in Q.all_violations(after).collect()}
    assert got == want and len(got) >= 5
    assert Q.append_violations(new.limit(0), "recipes", seed).count() == 0
    # the stored side is filtered by the batch's range of keys before it is joined
    seed["orders"].write.parquet(f"{tmp_path}/orders")
    stored = {**seed, "orders": spark.read.parquet(f"{tmp_path}/orders")}
    plan = Q.append_violations(seed["orders"].limit(2), "orders", stored)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(order_id," in plan
    df, seen = Q.observed(new, "recipes")
    df.write.parquet(f"{tmp_path}/recipes")
    assert seen.get["not_null:qty_required"] == 1 and seen.get["not_null:menu_id"] == 1
