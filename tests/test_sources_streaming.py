"""Sources, catalog, statement runner, sinks (S1-S9) and streaming."""

from __future__ import annotations

import datetime as dt
import re
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larder.schemas import SCHEMAS
from larder.sources import catalog, sinks
from larder.streaming import stock_stream as S
from tests.conftest import d, rows


def test_seed_defaults(spark):
    m = catalog.load_rows(spark, "menu_items", [dict(menu_id=8, name="Vegetable Soup",
                                                     category="Snacks", price=d(90))])
    r = m.first()
    assert (r.discount, r.is_available) == (d(0), 1)
    assert m.schema == SCHEMAS["menu_items"] or [f.dataType for f in m.schema.fields] == \
        [f.dataType for f in SCHEMAS["menu_items"].fields]


def test_typed_read_and_append(spark, seed):
    path = tempfile.mkdtemp(prefix="larder-app-") + "/menu"
    sinks.append(seed["menu_items"], path, batch="0")
    for _ in range(2):                                   # a retried batch adds nothing twice
        sinks.append(seed["menu_items"].limit(2), path, batch="1")
    back = catalog.read_table(spark, path, "menu_items")
    assert back.count() == 9 and back.schema["price"].dataType == SCHEMAS["menu_items"]["price"].dataType


def test_snapshot_versions(spark, seed):
    base = tempfile.mkdtemp(prefix="larder-snap-")
    assert sinks.read_latest(spark, base) is None
    sinks.commit_version(seed["ingredients"], base, 0)
    sinks.commit_version(seed["ingredients"].limit(3), base, 1, batch="b1")
    sinks.commit_version(seed["ingredients"].limit(3), base, 1, batch="b1")  # retried: kept
    for other in (None, "b2"):
        with pytest.raises(ValueError):
            sinks.commit_version(seed["ingredients"], base, 1, batch=other)
    assert sinks.latest_version(spark, base) == 1
    assert sinks.read_latest(spark, base).count() == 3
    assert sinks.read_latest(spark, base, before=1).count() == 10
    sinks.commit_version(seed["ingredients"].limit(1), base, 2)
    assert sinks.drop_old_versions(spark, base, keep=2) == [0]
    assert sinks.read_latest(spark, base).count() == 1
    with pytest.raises(ValueError):                      # a dropped number is not given again
        sinks.commit_version(seed["ingredients"], base, 0)


def test_catalog_tables_sorted_without_views(spark, seed):
    catalog.register_tables(spark, seed)
    catalog.register_views(spark, seed)
    names = catalog.catalog_tables(spark)
    assert names == sorted(names) and "menu_items" in names and "v_low_stock" not in names


def test_split_statements_respects_quotes_and_comments():
    s = "SELECT 'a;b' AS x; -- c;d\nSELECT \"e;f\";;  ; SELECT 1"
    assert catalog.split_statements(s) == ["SELECT 'a;b' AS x", "SELECT \"e;f\"", "SELECT 1"]
    assert catalog.split_statements("SELECT 'it''s;x'") == ["SELECT 'it''s;x'"]


def test_sql_script_errors_do_not_stop(spark, seed):
    catalog.register_tables(spark, seed)
    res = catalog.sql_script(spark, "SELECT count(*) AS n FROM menu_items; SELEC broken; "
                                    "SELECT name FROM menu_items WHERE price > 300")
    assert res[0].frame.first().n == 7
    assert res[1].error is not None
    assert rows(res[2].frame) == [("Beef Curry",)]
    assert catalog.sql_script(spark, "  ")[0].error == "empty statement"


def test_bound_parameters(spark, seed):
    catalog.register_tables(spark, seed)
    df = catalog.run_bound(spark, "SELECT m.name, oi.quantity FROM order_items oi JOIN menu_items m "
                                  "ON m.menu_id = oi.menu_id WHERE oi.order_id = :oid", oid=1)
    assert sorted(rows(df)) == [("Chicken Biryani", 2), ("Milk Tea", 1)]
    injected = catalog.run_bound(spark, "SELECT * FROM customers WHERE name = :n",
                                 n="x' OR '1'='1")
    assert injected.count() == 0


def _moves(spark, folder, data):
    df = spark.createDataFrame(data, "ingredient_id long, ts timestamp_ntz, ref long, "
                                     "delta decimal(12,2)")
    df.coalesce(1).write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def test_stream_stock_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="larder-st-")
    t0 = dt.datetime(2026, 8, 1)
    data = [(i % 3, t0 + dt.timedelta(minutes=i), i, Decimal(i % 7 - 3)) for i in range(60)]
    opening = spark.createDataFrame([(0, Decimal(10)), (5, Decimal(1))],
                                    "ingredient_id long, quantity decimal(20,2)")
    q = S.stream_stock(_moves(spark, f"{base}/in", data), f"{base}/state", f"{base}/ck")
    q.awaitTermination()
    got = dict(rows(S.read_balances(spark, f"{base}/state", opening)))
    want = {0: Decimal(10), 5: Decimal(1)}
    for k, _, _, v in data:
        want[k] = want.get(k, 0) + v
    assert got == want


def test_stream_stock_restarts_from_checkpoint(spark):
    base = tempfile.mkdtemp(prefix="larder-st2-")
    t0 = dt.datetime(2026, 8, 1)
    schema = "ingredient_id long, ts timestamp_ntz, ref long, delta decimal(12,2)"
    first = [(1, t0, 1, Decimal(5)), (2, t0, 2, Decimal(7))]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(f"{base}/in/p1")
    src = lambda: spark.readStream.schema(schema).parquet(f"{base}/in/*")
    opening = spark.createDataFrame([], "ingredient_id long, quantity decimal(20,2)")
    S.stream_stock(src(), f"{base}/state", f"{base}/ck").awaitTermination()
    second = [(1, t0, 3, Decimal(-2)), (3, t0, 4, Decimal(1))]
    spark.createDataFrame(second, schema).coalesce(1).write.parquet(f"{base}/in/p2")
    S.stream_stock(src(), f"{base}/state", f"{base}/ck").awaitTermination()
    got = dict(rows(S.read_balances(spark, f"{base}/state", opening)))
    assert got == {1: d(3), 2: d(7), 3: d(1)}


def test_stream_low_stock_crossings(spark):
    base = tempfile.mkdtemp(prefix="larder-low-")
    t0 = dt.datetime(2026, 8, 1)
    deltas = [30, -15, -10, 20, -30, -1]  # balance 30, 15, 5, 25, -5, -6; level 10
    data = [(1, t0 + dt.timedelta(hours=i * 2), i, Decimal(v)) for i, v in enumerate(deltas)]
    levels = spark.createDataFrame([(1, Decimal(10))], "ingredient_id long, reorder_level decimal(10,2)")
    opening = spark.createDataFrame([], "ingredient_id long, quantity decimal(20,2)")
    q = S.stream_low_stock(_moves(spark, f"{base}/in", data), levels, opening, f"{base}/state",
                           f"{base}/alerts", f"{base}/ck")
    q.awaitTermination()
    got = sorted(rows(spark.read.parquet(f"{base}/alerts"), "ref", "before", "after"))
    assert got == [(2, d(15), d(5)), (4, d(25), d(-5))]


def test_stream_daily_sales(spark):
    base = tempfile.mkdtemp(prefix="larder-ds-")
    t0 = dt.datetime(2026, 8, 1, 10)
    data = [(t0 + dt.timedelta(hours=7 * i), Decimal(10 + i)) for i in range(10)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, amount decimal(12,2)")
    df.coalesce(1).write.parquet(f"{base}/in")
    src = spark.readStream.schema(df.schema).parquet(f"{base}/in")
    q = S.stream_daily_sales(src, f"{base}/state", f"{base}/ck")
    q.awaitTermination()
    got = {str(r.day): (r.total_orders, r.total_sales)
           for r in S.read_daily_sales(spark, f"{base}/state").collect()}
    want = {}
    for ts, a in data:
        k = str(ts.date())
        n, s = want.get(k, (0, Decimal(0)))
        want[k] = (n + 1, s + a)
    assert got == want


def test_driver_contract_keys():
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80
    own = {k for k in qs if not re.match(r"op\d+_|pipeline$", k)}
    assert own <= set(sql)


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["name", "sold", "revenue"] and df.count() > 0


def test_registered_query_small_sf(spark):
    import __spark_entry__ as E
    df = E.queries()["daily_sales"](spark, "/root/testdata/sf0.001")
    assert df.filter(F.col("total_orders") <= 0).count() == 0 and df.count() > 0


def test_scale_settings():
    from larder.session import scale_settings
    s = scale_settings(100 * (1 << 40))
    assert int(s["spark.sql.shuffle.partitions"]) == 50_000
    assert int(scale_settings(1 << 40)["spark.sql.shuffle.partitions"]) == 4096
    assert scale_settings(1)["spark.sql.shuffle.partitions"] == "1"


def test_stream_daily_sales_ignores_session_zone(spark):
    base = tempfile.mkdtemp(prefix="larder-tz-")
    data = [(dt.datetime(2026, 8, 1, 1, 0), Decimal(1)), (dt.datetime(2026, 8, 1, 23, 0), Decimal(2)),
            (dt.datetime(2026, 8, 2, 0, 30), Decimal(4))]
    df = spark.createDataFrame(data, "ts timestamp_ntz, amount decimal(12,2)")
    df.coalesce(1).write.parquet(f"{base}/in")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        src = spark.readStream.schema(df.schema).parquet(f"{base}/in")
        S.stream_daily_sales(src, f"{base}/state", f"{base}/ck").awaitTermination()
        got = sorted((str(r.day), r.total_orders)
                     for r in S.read_daily_sales(spark, f"{base}/state").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [("2026-08-01", 2), ("2026-08-02", 1)]


def test_checkpoint_dir_read_from_session(spark):
    from larder.session import checkpoint_dir, cut_lineage
    d_ = checkpoint_dir(spark)
    assert d_ and "larder-test-ckpt-" in d_
    df = cut_lineage(spark.range(10))
    assert df.count() == 10


def test_stream_low_stock_across_batches(spark):
    base = tempfile.mkdtemp(prefix="larder-low2-")
    t0 = dt.datetime(2026, 8, 1)
    schema = "ingredient_id long, ts timestamp_ntz, ref long, delta decimal(12,2)"
    levels = spark.createDataFrame([(1, Decimal(10))], "ingredient_id long, reorder_level decimal(10,2)")
    opening = spark.createDataFrame([(1, Decimal(12))], "ingredient_id long, quantity decimal(20,2)")
    src = lambda: spark.readStream.schema(schema).parquet(f"{base}/in/*")
    run = lambda: S.stream_low_stock(src(), levels, opening, f"{base}/state",
                                     f"{base}/alerts", f"{base}/ck").awaitTermination()
    spark.createDataFrame([(1, t0, 1, Decimal(8))], schema).write.parquet(f"{base}/in/p1")
    run()   # 12 -> 20: no alert
    spark.createDataFrame([(1, t0 + dt.timedelta(hours=1), 2, Decimal(-11))], schema) \
        .write.parquet(f"{base}/in/p2")
    run()   # 20 -> 9: crossing, with the balance carried from the first batch
    got = rows(spark.read.parquet(f"{base}/alerts"), "ref", "before", "after")
    assert got == [(2, d(20), d(9))]


def test_late_sales_count_on_their_day(spark):
    """Batches 01-01, 01-10, 01-11 and then a late 01-01 sale: the day takes it."""
    base = tempfile.mkdtemp(prefix="larder-late-")
    schema = "ts timestamp_ntz, amount decimal(12,2)"
    src = lambda: spark.readStream.schema(schema).parquet(f"{base}/in/*")
    assert rows(S.read_daily_sales(spark, f"{base}/state")) == []
    for i, (day, amount) in enumerate([(1, 10), (10, 5), (11, 6), (1, 7)]):
        spark.createDataFrame([(dt.datetime(2026, 1, day, 9), Decimal(amount))], schema) \
            .write.parquet(f"{base}/in/p{i}")
        S.stream_daily_sales(src(), f"{base}/state", f"{base}/ck").awaitTermination()
    got = sorted((r.day.day, r.total_orders, r.total_sales)
                 for r in S.read_daily_sales(spark, f"{base}/state").collect())
    assert got == [(1, 2, d(17)), (10, 1, d(5)), (11, 1, d(6))]


def test_streams_read_a_folder_of_files_and_an_empty_table(spark, monkeypatch):
    """events.parquet as a folder of part files gives the same streams; without
    events they give empty frames.  Folding the changes changes nothing."""
    from larder.plans import stock_jobs
    from larder.sources.testdata import Tables
    monkeypatch.setattr(S, "FOLD_EVERY", 1)
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    base = tempfile.mkdtemp(prefix="larder-ev-")
    ev.repartition(3).write.parquet(f"{base}/many/events.parquet")
    ev.limit(0).write.parquet(f"{base}/none/events.parquet")
    for job in (stock_jobs._stream_stock, stock_jobs._stream_daily_sales,
                stock_jobs._stream_low_stock):
        one = sorted(map(str, job(Tables(spark, "/root/testdata/sf0.001")).collect()))
        assert sorted(map(str, job(Tables(spark, f"{base}/many")).collect())) == one and one
        assert job(Tables(spark, f"{base}/none")).count() == 0


def test_statement_splitter_comments_and_escapes():
    split = catalog.split_statements
    assert split("SELECT 1 /* a; b /* c; */ d */; SELECT 2") == ["SELECT 1", "SELECT 2"]
    assert split(r"SELECT 'it\'s; ok'; SELECT 3") == [r"SELECT 'it\'s; ok'", "SELECT 3"]
    assert split("SELECT `a;b` FROM t -- x;y") == ["SELECT `a;b` FROM t"]


def test_sql_script_reports_run_time_errors(spark):
    res = catalog.sql_script(spark, "SELECT 1/0 AS x; SELECT 1 AS a, 2 AS a, NULL AS b; SELECT 5 AS n")
    assert "DIVIDE_BY_ZERO" in res[0].error and res[0].frame is None
    assert res[1].columns == ["a", "a", "b"] and tuple(res[1].frame.first()) == (1, 2, None)
    assert res[2].frame.first().n == 5


def test_checkpoint_folder_is_required_on_a_cluster(spark, monkeypatch):
    from larder import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext = Context()
        conf = Context()
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_purchase_insert(spark, seed):
    from larder.operators import changes as U
    reqs = spark.createDataFrame([
        (1, 1, 1, d(5), d(50), dt.date(2026, 8, 1)), (2, 9, 1, d(5), d(50), None),
        (3, 1, 99, d(5), d(50), None), (4, 1, 2, d(0), d(50), None), (5, 2, 2, d(1), d(0), None)],
        "seq long, supplier_id long, ingredient_id long, quantity decimal(10,2), cost decimal(10,2), "
        "purchase_date date")
    ok, out = U.purchase_insert(seed["purchases"], seed["suppliers"], seed["ingredients"], reqs,
                                "2026-09-01")
    assert sorted((r.purchase_id, str(r.purchase_date)) for r in ok.collect()) == [
        (9, "2026-08-01"), (10, "2026-09-01")]
    assert {r.seq: r.reason for r in out.collect()} == {
        1: None, 2: "supplier not found", 3: "ingredient not found",
        4: "quantity must be above 0", 5: None}
