"""Deletes along the graph of foreign keys, statements over a store, price history."""

import datetime as dt
import itertools
import random
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larder.operators import changes as U
from larder.operators import history as H
from larder.operators import referential as R
from larder.operators import stock as T
from larder.schemas import SCHEMAS
from larder.sources import catalog, commits, statements
from tests.conftest import d, rows


def everything(df):
    return sorted(map(str, df.collect()))


# ------------------------------------------------------------------ graph

def test_graph_equals_the_hand_written_jobs(spark, seed):
    gone = spark.createDataFrame([(1,), (3,)], "customer_id long")
    c, u, o = U.delete_customers(seed["customers"], seed["users"], seed["orders"], gone)
    got = R.delete_where(seed, "customers", "customer_id IN (1, 3)")
    assert set(got.tables) == {"customers", "users", "orders"} and got.refused.count() == 0
    for name, want in (("customers", c), ("users", u), ("orders", o)):
        assert everything(got.tables[name].select(*sorted(SCHEMAS[name].names))) == \
            everything(want.select(*sorted(SCHEMAS[name].names)))
    o, i = U.delete_orders(seed["orders"], seed["order_items"], spark.createDataFrame([(2,)], "order_id long"))
    got = R.delete_where(seed, "orders", F.col("order_id") == 2)
    assert everything(got.tables["orders"]) == everything(o.select(*seed["orders"].columns))
    assert everything(got.tables["order_items"]) == everything(i.select(*seed["order_items"].columns))


@pytest.mark.parametrize("table", list(SCHEMAS))
def test_delete_from_any_table_matches_a_plain_walk(spark, seed, table):
    """All or nothing, for every table of the schema, against loops over rows."""
    key = SCHEMAS[table].names[0]
    values = sorted(r[0] for r in seed[table].select(key).distinct().collect())
    for chosen in ([], values[:1], values[-1:], values):
        got = R.delete_where(seed, table, F.col(key).isin(chosen) if chosen else F.lit(None).cast("boolean"))
        data = {t: [r.asDict() for r in seed[t].collect()] for t in SCHEMAS}
        dead = {table: [r for r in data[table] if r[key] in chosen]}
        todo = [table]
        for t in todo:
            for e in R.schema_graph():
                if e.parent == t and e.action == R.CASCADE:
                    keys = {r[e.parent_col] for r in dead[t]}
                    dead[e.child] = [r for r in data[e.child] if r[e.col] in keys]
                    todo.append(e.child)
        refused = {(e.child, e.col) for e in R.schema_graph() if e.action == R.RESTRICT and e.parent in dead
                   for r in data[e.child] if r[e.col] in {x[e.parent_col] for x in dead[e.parent]}}
        assert {(r.child, r.column) for r in got.refused.collect()} == refused
        for t, df in got.tables.items():
            after = data[t] if refused else [r for r in data[t] if r not in dead.get(t, [])]
            for e in R.schema_graph():
                if e.child == t and e.action == R.SET_NULL and e.parent in dead and not refused:
                    keys = {x[e.parent_col] for x in dead[e.parent]}
                    after = [{**r, e.col: None if r[e.col] in keys else r[e.col]} for r in after]
            assert sorted(map(str, (r.asDict() for r in df.collect()))) == sorted(map(str, after)), (table, t)


def test_cascades_go_through_several_tables(spark):
    """A declared graph of four tables: cascade over two steps, set-null and restrict below."""
    t = {"a": spark.createDataFrame([(1,), (2,), (3,)], "a long"),
         "b": spark.createDataFrame([(10, 1), (20, 2), (30, None)], "b long, a long"),
         "c": spark.createDataFrame([(100, 10), (200, 20), (300, 30)], "c long, b long"),
         "n": spark.createDataFrame([(1, 100), (2, 300)], "n long, c long"),
         "x": spark.createDataFrame([(200,)], "c long")}
    graph = [R.Edge("b", "a", "a", "a", R.CASCADE), R.Edge("c", "b", "b", "b", R.CASCADE),
             R.Edge("n", "c", "c", "c", R.SET_NULL), R.Edge("x", "c", "c", "c", R.RESTRICT)]
    got = R.delete_where(t, "a", "a = 1", graph)
    assert {k: sorted(map(tuple, v.collect()), key=str) for k, v in got.tables.items()} == {
        "a": [(2,), (3,)], "b": [(20, 2), (30, None)], "c": [(200, 20), (300, 30)], "n": [(1, None), (2, 300)]}
    got = R.delete_where(t, "a", "a <= 2", graph)                # b 20, c 200: something refers to it
    assert rows(got.refused) == [("x", "c", 1)]
    assert all(everything(v) == everything(t[k]) for k, v in got.tables.items())
    with pytest.raises(ValueError):
        R.delete_where(t, "a", "a = 1", graph + [R.Edge("a", "a", "c", "c", R.CASCADE)])


# ------------------------------------------------------------------ statements

@pytest.fixture
def store(spark, seed):
    s = commits.Store(spark, tempfile.mkdtemp(prefix="larder-dml-"))
    s.commit(s.snapshot(), replace={t: seed[t] for t in SCHEMAS})
    return s


def test_script_with_changes(spark, store):
    res = catalog.sql_script(spark, """
        INSERT INTO menu_items (name, category, price) VALUES ('Lentil Soup', 'Starters', 90.5), ('Tea; green', 'Drinks', 20);
        SELECT count(*) AS n FROM menu_items WHERE menu_id > 7;
        UPDATE menu_items SET price = price + 10, discount = DEFAULT WHERE name LIKE '%Soup';
        UPDATE menu_items SET price = 0;
        DELETE FROM menu_items WHERE name = 'Lentil Soup';
        INSERT INTO menu_items (name, category, price) VALUES ('New', 'Drinks', 5);
        SELECT menu_id, name, price, discount, is_available FROM menu_items WHERE menu_id > 7 ORDER BY menu_id
    """, store)
    assert [r.rows for r in res] == [2, None, 1, None, 1, 1, None]
    assert res[0].frame.count() == 9 and res[1].frame.first().n == 2
    assert "check:price > 0: 9 rows" in res[3].error
    assert rows(res[6].frame) == [(9, "Tea; green", d(20), d(0), 1), (10, "New", d(5), d(0), 1)]   # id 8 is not given again
    assert store.read("menu_items").count() == 9


def test_statements_that_are_refused_change_nothing(spark, store):
    before = store.version()
    bad = {
        "INSERT INTO menu_items (name, category, price) VALUES ('x', 'y', -1)": "check:price > 0",
        "INSERT INTO menu_items (name, category, price) VALUES ('Milk Tea', 'Drinks', 5)": "unique:name",
        "INSERT INTO order_items (order_id, menu_id, quantity, price) VALUES (999, 1, 1, 5)": "fk:order_id",
        "INSERT INTO menu_items (name, category) VALUES ('x', 'y')": "not_null:price",
        "INSERT INTO menu_items (nme) VALUES ('x')": "no column",
        "INSERT INTO menu_items (name, price) VALUES ('x')": "values for",
        "INSERT OVERWRITE menu_items SELECT * FROM menu_items": "not supported",
        "UPDATE orders SET status = 'Done' WHERE order_id = 1": "check:status",
        "UPDATE orders SET employee_id = 77": "fk:employee_id",
        "UPDATE menu_items SET menu_id = 99 WHERE menu_id = 1": "may refer",
        "UPDATE menu_items SET nothing = 1": "no column",
        "UPDATE customers SET phone = 'same'": "unique:phone",
        "DELETE FROM employees WHERE employee_id IN (SELECT 1)": None,
        "DELETE FROM ingredients": "refer to it",
        "DELETE FROM nothing": "no table",
        "MERGE INTO orders USING customers ON orders.customer_id = customers.customer_id WHEN MATCHED THEN DELETE": "not supported",
    }
    for sql, why in bad.items():
        r = catalog.sql_script(spark, sql, store)[0]
        assert r.error is not None and (why is None or why in r.error), (sql, r.error)
    assert store.version() == before
    # without a store the tables cannot be changed
    assert catalog.sql_script(spark, "DELETE FROM orders")[0].error is not None


def test_delete_statement_follows_foreign_keys(spark, store, seed):
    done = statements.run(store, "DELETE FROM customers WHERE customer_id = 1")
    assert done.rows == 1 and done.frame.filter("customer_id = 1").count() == 0
    want = R.delete_where(seed, "customers", "customer_id = 1").tables
    for t in ("users", "orders"):
        assert everything(store.read(t)) == everything(want[t])
    assert statements.run(store, "DELETE FROM customers WHERE customer_id = NULL").rows == 0


# ------------------------------------------------------------------ history

LOG = "menu_id long, valid_from timestamp_ntz, price decimal(10,2), discount decimal(5,2), is_available int"


def _log(rnd, n, items, micros=False):
    t0 = dt.datetime(2020, 1, 1)
    out = {}
    for _ in range(n):
        t = t0 + dt.timedelta(minutes=rnd.randrange(0, 3_000_000), microseconds=rnd.randrange(3) if micros else 0)
        out[rnd.randrange(items), t] = (Decimal(rnd.randrange(1, 900)), Decimal(rnd.randrange(0, 50)), rnd.randrange(2))
    return [(i, t, *v) for (i, t), v in out.items()]


def test_history_merged_by_batches_equals_one_build(spark):
    rnd = random.Random(11)
    log = _log(rnd, 150, 6, micros=True)
    whole = H.build_history(spark.createDataFrame(log, LOG))
    want = []
    for _, g in itertools.groupby(sorted(log), key=lambda x: x[0]):
        g = list(g)
        want += [(x[0], x[1], y[1] if y else None, *x[2:]) for x, y in zip(g, [*g[1:], None])]
    assert sorted(rows(whole), key=str) == sorted(want, key=str)
    rnd.shuffle(log)
    h = H.build_history(spark.createDataFrame(log[:50], LOG))
    for k in (50, 100):
        h = H.merge_history(h, spark.createDataFrame(log[k:k + 50], LOG))
    assert sorted(rows(h), key=str) == sorted(want, key=str)
    # a change of the same time replaces the version
    i, t = log[0][:2]
    h = H.merge_history(whole, spark.createDataFrame([(i, t, d(1), d(0), 1)], LOG))
    assert rows(h.filter((F.col("menu_id") == i) & (F.col("valid_from") == t)), "price") == [(d(1),)]
    assert h.count() == len(want)
    assert H.build_history(spark.createDataFrame([], LOG)).count() == 0


def test_interval_join_equals_as_of(spark):
    rnd = random.Random(12)
    log = _log(rnd, 200, 5) + [(9, dt.datetime(1900, 1, 1), d(5), d(0), 1), (9, dt.datetime(2024, 5, 5), d(6), d(0), 1)]
    t0 = dt.datetime(2019, 6, 1)
    lines = [(k, rnd.randrange(7), t0 + dt.timedelta(minutes=rnd.randrange(0, 3_500_000))) for k in range(400)]
    lines += [(400 + k, i, t + dt.timedelta(microseconds=x)) for k, ((i, t, *_), x) in enumerate(zip(log, itertools.cycle([-1, 0, 1])))]
    lines += [(900, 9, dt.datetime(2023, 1, 1)), (901, 9, dt.datetime(3000, 1, 1)), (902, 9, dt.datetime(1850, 1, 1))]
    ln = spark.createDataFrame(lines, "order_item_id long, menu_id long, order_date timestamp_ntz")
    lg = spark.createDataFrame(log, LOG)
    want = T.price_as_of(ln, lg)
    got = H.price_from_history(ln, H.build_history(lg))
    assert got.columns == want.columns
    assert everything(got) == everything(want) and want.filter("available").count() > 100


def test_open_versions_take_few_bins_and_are_not_sent_whole(spark):
    old = [(k, dt.datetime(1990, 1, 1) if k else dt.datetime(1900, 1, 1), d(5), d(0), 1) for k in range(50)]
    h = H.build_history(spark.createDataFrame(old, LOG))
    assert H.version_bins(h).count() == 51          # 89 a version before; two from before 1970
    lines = spark.createDataFrame([(1, 3, dt.datetime(2020, 1, 1)), (2, 3, dt.datetime(9999, 12, 30)), (3, 0, dt.datetime(1950, 1, 1))],
                                  "order_item_id long, menu_id long, order_date timestamp_ntz")
    got = H.price_from_history(lines, h)
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()
    assert rows(got.orderBy("order_item_id"), "price") == [(d(5),)] * 3
