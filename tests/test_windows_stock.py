"""Two-level window primitives, ids, ledger and stock jobs against plain
serial reference loops (brute force on small inputs)."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larder.operators import stock as T
from larder.operators import windows as W
from larder.sources.catalog import load_rows
from tests.conftest import d, rows


def _hot_rows(n=400, keys=5, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = 0 if rnd.random() < 0.5 else rnd.randrange(1, keys)  # key 0 is hot
        out.append((k, i * 3 + rnd.randrange(3), rnd.randrange(-50, 50)))
    return out


def test_running_total_matches_brute_force_across_chunks(spark):
    data = _hot_rows()
    df = spark.createDataFrame(data, "k long, seq long, v long")
    got = rows(W.running_total(df, "k", ["seq"], "v", W.seq_chunk("seq", 7)), "k", "seq", "running")
    acc, want = defaultdict(int), []
    for k, s, v in sorted(data, key=lambda r: r[1]):
        acc[k] += v
        want.append((k, s, acc[k]))
    assert sorted(got) == sorted(want)


def test_asof_last_matches_brute_force(spark):
    rnd = random.Random(2)
    data = [(rnd.randrange(3), i, rnd.choice([None, None, rnd.randrange(100)])) for i in range(300)]
    df = spark.createDataFrame(data, "k long, seq long, v long")
    for inclusive in (True, False):
        got = rows(W.asof_last(df, "k", ["seq"], "v", W.seq_chunk("seq", 5), out="o",
                               inclusive=inclusive), "k", "seq", "o")
        last, want = {}, []
        for k, s, v in data:
            if inclusive and v is not None:
                last[k] = v
            want.append((k, s, last.get(k)))
            if not inclusive and v is not None:
                last[k] = v
        assert sorted(got, key=str) == sorted(want, key=str)


def test_assign_ids_consecutive_in_order(spark):
    df = spark.range(0, 500, 1, 7).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    got = rows(W.assign_ids(df, ["x"], start=101), "x", "id")
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == list(range(101, 601))
    assert [r[0] for r in got] == sorted(r[0] for r in got)


def test_stock_ledger_conservation(seed):
    moves = W.movements(seed["purchases"], seed["order_items"], seed["orders"], seed["recipes"])
    led = W.stock_ledger(seed["ingredients"], moves)
    final = {}
    for r in led.orderBy("ts", "kind", "ref").collect():
        final[r.ingredient_id] = r.after
    opening = {r.ingredient_id: r.quantity for r in seed["ingredients"].collect()}
    bought = defaultdict(Decimal)
    for r in seed["purchases"].collect():
        bought[r.ingredient_id] += r.quantity
    used = {r.ingredient_id: r.used for r in T.recipe_use(seed["order_items"],
                                                          seed["recipes"]).collect()}
    for i, q in final.items():
        assert q == opening[i] + bought[i] - used.get(i, 0)


def test_apply_purchases(seed):
    got = dict(rows(T.apply_purchases(seed["ingredients"], seed["purchases"]), "name", "quantity"))
    assert got["Rice"] == d(100) and got["Oil"] == d(43) and got["Flour"] == d(22)


def test_trigger_demo_one_biryani(spark, seed):
    orders = load_rows(spark, "orders", [dict(order_id=7, customer_id=2, employee_id=3,
                                              order_date=dt.datetime(2026, 8, 4, 12, 0))])
    items = load_rows(spark, "order_items", [dict(order_item_id=8, order_id=7, menu_id=1,
                                                  quantity=1, price=d(280))])
    ing, o = T.apply_order_items(seed["ingredients"], orders, items, seed["recipes"])
    got = dict(rows(ing, "ingredient_id", "quantity"))
    assert (got[1], got[2], got[6], got[10]) == (d("49.75"), d("11.70"), d("17.95"), d("3.98"))
    assert got[3] == d(8)
    assert o.first().total_amount == d(280)


# ---------------------------------------------------------------- T3 vs a serial loop

def _serial_place(requests, menu, recipes, opening, restocks):
    stock = dict(opening)
    avail = {m: (a, fp) for m, a, fp in menu}
    rec = defaultdict(list)
    for m, i, q in recipes:
        rec[m].append((i, q))
    events = [(s, 0, ("R", i, q)) for s, i, q in restocks] + \
             [(s, 1, ("O", cart)) for s, cart in requests]
    out = {}
    for s, _, ev in sorted(events, key=lambda e: (e[0], e[1])):
        if ev[0] == "R":
            stock[ev[1]] = stock.get(ev[1], 0) + ev[2]
            continue
        cart = ev[1]
        if not cart:
            out[s] = (False, "empty cart")
            continue
        if any(avail.get(m, (0, None))[0] != 1 for m in cart):
            out[s] = (False, "item not available")
            continue
        need = defaultdict(Decimal)
        for m, q in cart.items():
            for i, r in rec[m]:
                need[i] += r * q
        if all(stock.get(i, 0) - n >= 0 for i, n in need.items()):
            for i, n in need.items():
                stock[i] = stock.get(i, 0) - n
            out[s] = (True, None)
        else:
            out[s] = (False, "not enough stock")
    return out, stock


def _random_requests(rnd, n, menu_ids):
    reqs = []
    for s in range(n):
        k = rnd.choice([0, 1, 1, 2, 3])
        cart = {m: rnd.randrange(1, 9) for m in rnd.sample(menu_ids, k)}
        reqs.append((s * 10, cart))
    return reqs


def test_place_orders_matches_serial_loop(spark, seed):
    rnd = random.Random(7)
    menu = seed["menu_items"].unionByName(load_rows(spark, "menu_items", [dict(
        menu_id=8, name="Water", category="Drinks", price=d(20))]))  # available, no recipe
    menu_rows = [(r.menu_id, r.is_available, r.price - (r.price * r.discount / 100))
                 for r in menu.collect()]
    rec_rows = [(r.menu_id, r.ingredient_id, r.qty_required) for r in seed["recipes"].collect()]
    # small opening stock so that many orders oversell; Oil is in 3 recipes (hot)
    opening = {i: Decimal(rnd.randrange(0, 4)) for i in range(1, 11)}
    ing = seed["ingredients"].drop("quantity").join(
        spark.createDataFrame([(k, v) for k, v in opening.items()],
                              "ingredient_id long, quantity decimal(10,2)"), "ingredient_id")
    reqs = _random_requests(rnd, 120, [1, 2, 3, 4, 5, 6, 7, 8, 99])
    restocks = [(s * 10 + 5, rnd.randrange(1, 11), Decimal(rnd.randrange(1, 4)))
                for s in range(0, 120, 9)]
    req_df = spark.createDataFrame(
        [(s, 1, dt.datetime(2026, 8, 5), {m: (str(m), q) for m, q in c.items()} or None)
         for s, c in reqs],
        "seq long, customer_id long, ts timestamp, cart map<long, struct<name string, qty int>>")
    rs_df = spark.createDataFrame(restocks, "seq long, ingredient_id long, quantity decimal(10,2)")
    res = T.place_orders(req_df, menu, seed["recipes"], ing, seed["employees"], seed["orders"],
                         seed["order_items"], restocks=rs_df, chunk_size=16)
    want, want_stock = _serial_place(reqs, menu_rows, rec_rows, opening,
                                     [(s, i, q) for s, i, q in restocks])
    got = {r.seq: (r.accepted, r.reason) for r in res["outcomes"].collect()}
    assert got == want
    assert sum(1 for v in want.values() if v == (False, "not enough stock")) > 5
    stock = dict(rows(res["ingredients"], "ingredient_id", "quantity"))
    assert all(stock[i] == want_stock[i] for i in stock)
    ids = sorted(r.order_id for r in res["orders"].collect())
    assert ids == list(range(7, 7 + len(ids)))
    assert {r.employee_id for r in res["orders"].collect()} == {3}
    assert len(res["rounds"]) == 1                        # few rows: decided in order at once
    again = T.place_orders(req_df, menu, seed["recipes"], ing, seed["employees"], seed["orders"],
                           seed["order_items"], restocks=rs_df, chunk_size=16, serial_rows=10)
    assert {r.seq: (r.accepted, r.reason) for r in again["outcomes"].collect()} == want
    sizes = again["rounds"]
    assert 2 <= len(sizes) <= T.BOUND_ROUNDS + 1 and sizes == sorted(sizes, reverse=True)


def test_place_orders_no_oversell_is_one_round(spark, seed):
    req_df = spark.createDataFrame(
        [(1, 1, dt.datetime(2026, 8, 5), {1: ("b", 1)}), (2, 2, dt.datetime(2026, 8, 5),
                                                         {1: ("b", 2), 6: ("t", 1)})],
        "seq long, customer_id long, ts timestamp, cart map<long, struct<name string, qty int>>")
    res = T.place_orders(req_df, seed["menu_items"], seed["recipes"], seed["ingredients"],
                         seed["employees"], seed["orders"], seed["order_items"])
    assert len(res["rounds"]) == 0                        # nothing is scarce
    got = {r.seq: (r.accepted, r.total) for r in res["outcomes"].collect()}
    assert got == {1: (True, d(252)), 2: (True, d(544))}
    lines = rows(res["order_items"].orderBy("order_item_id"), "order_item_id", "price")
    assert lines == [(8, d(252)), (9, d(252)), (10, d(40))]


def test_price_as_of_matches_brute_force(spark):
    rnd = random.Random(3)
    base = dt.datetime(2026, 1, 1)
    log = []
    for m in range(3):
        t = base
        for _ in range(6):
            log.append((m, t, Decimal(rnd.randrange(10, 99)), Decimal(rnd.choice([0, 10])),
                        rnd.choice([1, 1, 0])))
            t += dt.timedelta(days=rnd.randrange(1, 20))
    lines = [(i, rnd.randrange(3), base + dt.timedelta(days=rnd.randrange(-5, 90)))
             for i in range(200)]
    log_df = spark.createDataFrame(log, "menu_id long, valid_from timestamp_ntz, price decimal(10,2),"
                                        " discount decimal(5,2), is_available int")
    ln_df = spark.createDataFrame(lines, "order_item_id long, menu_id long, order_date timestamp_ntz")
    got = {r.order_item_id: r.price for r in T.price_as_of(ln_df, log_df, 86400 * 7).collect()}
    for i, m, t in lines:
        vers = [v for v in log if v[0] == m and v[1] <= t]
        if not vers or max(vers, key=lambda v: v[1])[4] != 1:
            assert got[i] is None
        else:
            v = max(vers, key=lambda v: v[1])
            want = (v[2] - v[2] * v[3] / 100).quantize(Decimal("0.01"))
            assert got[i] == want


def test_range_chunks_split_hot_key_and_stay_exact(spark):
    data = _hot_rows(n=2000, seed=9)
    df = spark.createDataFrame(data, "k long, seq long, v long")
    chunked = W.with_chunks(df, ["k"], ["seq"], None)
    hot_chunks = chunked.filter("k = 0").select("_chunk").distinct().count()
    assert hot_chunks > 1  # the hot key is spread over several partitions
    # every key hot, one key hot, none hot
    same = [rows(W.running_total(df, "k", ["seq"], "v", hot_rows=n), "k", "seq", "running")
            for n in (0, 500, 1 << 20)]
    assert sorted(same[0]) == sorted(same[1]) == sorted(same[2])
    got = same[0]
    acc, want = defaultdict(int), []
    for k, s, v in sorted(data, key=lambda r: r[1]):
        acc[k] += v
        want.append((k, s, acc[k]))
    assert sorted(got) == sorted(want)
    rnd = random.Random(4)
    data2 = [(0 if rnd.random() < 0.6 else rnd.randrange(1, 4), i,
              rnd.choice([None, None, rnd.randrange(100)])) for i in range(1500)]
    df2 = spark.createDataFrame(data2, "k long, seq long, v long")
    last, want2 = {}, []
    for k, s, v in data2:
        if v is not None:
            last[k] = v
        want2.append((k, s, last.get(k)))
    for n in (0, 500, 1 << 20):
        got2 = rows(W.asof_last(df2, "k", ["seq"], "v", out="o", hot_rows=n), "k", "seq", "o")
        assert sorted(got2, key=str) == sorted(want2, key=str)


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows_=st.lists(st.tuples(st.integers(0, 3), st.integers(-20, 20)), min_size=1,
                      max_size=120),
       size=st.one_of(st.none(), st.integers(1, 9)))
def test_running_total_property(spark, rows_, size):
    data = [(k, i, v) for i, (k, v) in enumerate(rows_)]
    df = spark.createDataFrame(data, "k long, seq long, v long")
    chunk = None if size is None else W.seq_chunk("seq", size)
    got = sorted(rows(W.running_total(df, "k", ["seq"], "v", chunk), "k", "seq", "running"))
    acc, want = defaultdict(int), []
    for k, s, v in data:
        acc[k] += v
        want.append((k, s, acc[k]))
    assert got == sorted(want)


def test_place_orders_chain_needs_few_rounds(spark, seed):
    """Order i uses ingredients i and i+1, one unit of each in stock: every second
    order is refused, each decision depends on the one before, and the number
    of rounds does not depend on the chain's length."""
    n = 60
    menu = load_rows(spark, "menu_items", [dict(menu_id=i, name=f"m{i}", category="c", price=d(1))
                                           for i in range(n)])
    rec = spark.createDataFrame([(i, i + j, d(1)) for i in range(n) for j in (0, 1)],
                                "menu_id long, ingredient_id long, qty_required decimal(10,2)")
    ing = load_rows(spark, "ingredients", [dict(ingredient_id=i, name=f"i{i}", unit="kg", quantity=d(1),
                                                unit_price=d(1)) for i in range(n + 1)])
    req = spark.createDataFrame(
        [(i, 1, dt.datetime(2026, 8, 5), {i: ("x", 1)}) for i in range(n)],
        "seq long, customer_id long, ts timestamp, cart map<long, struct<name string, qty int>>")
    for serial, rounds in ((100_000, 1), (30, T.BOUND_ROUNDS + 1), (0, T.BOUND_ROUNDS + 1)):
        res = T.place_orders(req, menu, rec, ing, seed["employees"], seed["orders"],
                             seed["order_items"], serial_rows=serial)
        got = {r.seq: r.accepted for r in res["outcomes"].collect()}
        assert got == {i: i % 2 == 0 for i in range(n)} and len(res["rounds"]) <= rounds


def test_place_orders_rejects_quantities_of_zero_or_less(spark, seed):
    req = spark.createDataFrame(
        [(1, 1, dt.datetime(2026, 8, 5), {6: ("t", -5)}), (2, 1, dt.datetime(2026, 8, 5), {6: ("t", 0)}),
         (3, 1, dt.datetime(2026, 8, 5), {6: ("t", 1)})],
        "seq long, customer_id long, ts timestamp, cart map<long, struct<name string, qty int>>")
    res = T.place_orders(req, seed["menu_items"], seed["recipes"], seed["ingredients"],
                         seed["employees"], seed["orders"], seed["order_items"])
    assert {r.seq: r.reason for r in res["outcomes"].collect()} == {
        1: "quantity must be above 0", 2: "quantity must be above 0", 3: None}
    stock = dict(rows(res["ingredients"], "ingredient_id", "quantity"))
    assert stock[7] == d("4.85")


def test_apply_purchases_beyond_ten_digits(spark, seed):
    more = spark.createDataFrame([(100 + i, 1, 1, d("99999999.99"), d(1), dt.date(2026, 1, 1)) for i in range(3)],
                                 "purchase_id long, supplier_id long, ingredient_id long, "
                                 "quantity decimal(10,2), cost decimal(10,2), purchase_date date")
    got = dict(rows(T.apply_purchases(seed["ingredients"], more), "ingredient_id", "quantity"))
    assert got[1] == d("300000049.97")


def test_components_match_union_find(spark):
    from larder.operators.components import components
    rnd = random.Random(3)
    for n, m in ((30, 12), (60, 45), (200, 150)):
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(500, 540)]
        pairs += [(1000, k) for k in range(1001, 1060)]               # a chain and a hub
        root = {x: x for p in pairs for x in p}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        got = components(spark.createDataFrame(pairs, "a long, b long"))
        assert dict(rows(got)) == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _chains(spark, n_chains, length):
    """Independent chains: order i of a chain needs ingredients i and i+1 of it."""
    k = n_chains * (length + 1)
    menu = load_rows(spark, "menu_items", [dict(menu_id=i, name=f"m{i}", category="c", price=d(1)) for i in range(k)])
    rec = spark.createDataFrame([(c * (length + 1) + i, c * (length + 1) + i + j, d(1))
                                 for c in range(n_chains) for i in range(length) for j in (0, 1)],
                                "menu_id long, ingredient_id long, qty_required decimal(10,2)")
    ing = load_rows(spark, "ingredients", [dict(ingredient_id=i, name=f"i{i}", unit="kg", quantity=d(1),
                                                unit_price=d(1)) for i in range(k)])
    req = spark.createDataFrame(
        [(i * n_chains + c, 1, dt.datetime(2026, 8, 5), {c * (length + 1) + i: ("x", 1)})
         for c in range(n_chains) for i in range(length)],
        "seq long, customer_id long, ts timestamp, cart map<long, struct<name string, qty int>>")
    return menu, rec, ing, req


def test_place_orders_decides_independent_chains_by_components(spark, seed):
    sizes = []
    for n_chains, length in ((4, 6), (12, 12), (20, 20)):
        menu, rec, ing, req = _chains(spark, n_chains, length)
        res = T.place_orders(req, menu, rec, ing, seed["employees"], seed["orders"], seed["order_items"],
                             serial_rows=0)
        assert {r.seq: r.accepted for r in res["outcomes"].collect()} == {
            i * n_chains + c: i % 2 == 0 for c in range(n_chains) for i in range(length)}
        sizes.append(len(res["rounds"]))
    assert max(sizes) <= 3                               # whatever the contended size


def test_conflicts_have_a_component_for_each_chain(spark):
    und = spark.createDataFrame([(i * 5 + c, c * 100 + i + j, d(1), d(-1), d(1))
                                 for c in range(5) for i in range(8) for j in (0, 1)]
                                + [(99, 700, d(1), d(3), d(4)), (98, 700, d(1), d(4), d(5))],     # never short
                                "seq long, ingredient_id long, need decimal(20,4), low decimal(20,4), up decimal(20,4)")
    got = T._conflicts(und, 0, 82)
    assert {tuple(r) for r in got.select(F.expr("ingredient_id div 100"), "component").distinct().collect()} == {
        (c, c * 100) for c in range(5)}
    assert got.count() == 80


def test_orders_lines_and_stock_are_committed_together(spark, seed, monkeypatch):
    import tempfile

    from larder.sources import commits
    store = commits.Store(spark, tempfile.mkdtemp(prefix="larder-orders-"))
    store.commit(store.snapshot(), replace={k: seed[k] for k in ("orders", "order_items", "ingredients")})

    def request(seq, cart):
        return spark.createDataFrame([(seq, 1, dt.datetime(2026, 8, 5), cart)],
                                     "seq long, customer_id long, ts timestamp, cart map<long, struct<name string, qty int>>")

    def place(seq, cart, batch):
        return T.commit_orders(store, request(seq, cart), seed["menu_items"], seed["recipes"], seed["employees"], batch)

    def consistent():
        """Lines without orders, and stock that orders of the store do not explain."""
        s = store.snapshot()
        n = seed["orders"].agg(F.max("order_id")).first()[0]
        new = s.read("order_items").filter(F.col("order_id") > n)
        assert new.join(s.read("orders"), "order_id", "left_anti").count() == 0
        want, _ = T.apply_order_items(seed["ingredients"], seed["orders"], new, seed["recipes"])
        assert sorted(rows(s.read("ingredients"), "ingredient_id", "quantity")) == sorted(
            rows(want, "ingredient_id", "quantity"))
        return sorted(r.order_id for r in s.read("orders").filter(F.col("order_id") > n).collect())
    place(1, {1: ("b", 1)}, "one")
    assert consistent() == [7]
    # the writer dies after the data are written, before they are committed
    put = commits.put_if_absent
    monkeypatch.setattr(commits, "put_if_absent", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        place(2, {1: ("b", 2)}, "two")
    assert consistent() == [7]
    # another writer commits in between: placed again on what it left

    def late(*a):
        monkeypatch.setattr(commits, "put_if_absent", put)
        place(3, {6: ("t", 1)}, "three")
        return put(*a)
    monkeypatch.setattr(commits, "put_if_absent", late)
    place(2, {1: ("b", 2)}, "two")
    assert consistent() == [7, 8, 9]
    place(2, {1: ("b", 2)}, "two")                        # a retried batch
    assert consistent() == [7, 8, 9]
    # the last order is deleted: its id is not given again
    s = store.snapshot()
    store.commit(s, replace={"orders": s.read("orders").filter("order_id < 9"),
                             "order_items": s.read("order_items").filter("order_id < 9"),
                             "ingredients": s.read("ingredients")})
    place(4, {6: ("t", 1)}, "four")
    assert sorted(r.order_id for r in store.read("orders").collect())[-2:] == [8, 10]


def test_rounds_go_on_while_many_rows_are_open(spark, seed, monkeypatch):
    big = T.MANY_OPEN
    assert not T._rounds_end([8 * big, 6 * big]) and not T._rounds_end([9 * big, 7 * big, 6 * big, 5 * big, 4 * big, 3 * big])
    assert T._rounds_end([8 * big, 7 * big, 7 * big])                 # a chain: by components
    assert T._rounds_end([8, 5]) and not T._rounds_end([8, 4]) and T._rounds_end([64, 32, 16, 8, 4])
    # rounds after BOUND_ROUNDS decide as the others do
    monkeypatch.setattr(T, "MANY_OPEN", 1)
    menu, rec, ing, req = _chains(spark, 3, 6)
    res = T.place_orders(req, menu, rec, ing, seed["employees"], seed["orders"], seed["order_items"], serial_rows=0)
    assert {r.seq: r.accepted for r in res["outcomes"].collect()} == {i * 3 + c: i % 2 == 0 for c in range(3) for i in range(6)}
    assert len(res["rounds"]) > T.BOUND_ROUNDS


def test_ledger_counts_movements_from_above_without_making_them(spark, seed):
    made = W.movements(seed["purchases"], seed["order_items"], seed["orders"], seed["recipes"])
    most = W.most_movements(seed["purchases"], seed["order_items"], seed["recipes"])
    n = {r.ingredient_id: r["count"] for r in made.groupBy("ingredient_id").count().collect()}
    bound = dict(rows(most, "ingredient_id", "_n"))
    assert n and all(bound[i] >= k for i, k in n.items())
    want = sorted(tuple(r) for r in W.stock_ledger(seed["ingredients"], made).collect())
    led = W.stock_ledger(seed["ingredients"], made, counts=most)
    assert sorted(tuple(r) for r in led.collect()) == want
    _, hot = W.split_hot(made, ["ingredient_id"], 3, most)
    assert hot.count() == sum(k for i, k in n.items() if bound[i] > 3)
