"""Plan properties of the registered queries (what matters at scale):
no Python UDF in any plan, scans read only the columns a query needs, no table
is hinted to be broadcast, and filters on stored columns reach the parquet scan."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
# these run actions (checkpoints, streams, admission rounds) while planning
EAGER = {"place_orders", "assign_ids", "menu_insert", "ingredient_change", "stream_stock",
         "stream_daily_sales", "stream_low_stock", "stock_ledger", "price_as_of",
         "apply_menu_changes", "sink_append", "sink_snapshot", "menu_by_category", "sql_script",
         "order_cancel", "status_fold", "cart_merge", "place_orders_orders", "place_orders_lines", "place_orders_stock", "purchase_outcomes",
         "stream_stock_raw", "stream_order_totals", "stream_sales_view", "sql_dml", "price_history",
         "price_from_history"}


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    qs = E.queries()
    return {k: _plan(fn(spark, SF)) for k, fn in qs.items()
            if k not in EAGER and not re.match(r"op\d+_|pipeline$", k)}


def test_no_python_udfs(plans):
    bad = [k for k, p in plans.items() if "EvalPython" in p or "PythonUDF" in p]
    assert bad == []


def test_scans_are_pruned(plans):
    # lineitem has 11 columns; no registered query needs all of them
    for k, p in plans.items():
        for schema in re.findall(r"ReadSchema: (struct<[^\n]*>)", p):
            if "l_orderkey" in schema:
                assert "l_tax" not in schema, k


def test_filter_reaches_scan(plans):
    assert "EqualTo(l_returnflag,R)" in plans["purchase_history"]
    assert "EqualTo(p_type,PROMO)" in plans["filter_and_eq"]


def test_aggregate_before_join(plans):
    # order_listing counts items per order before the left join: the
    # lineitem side is aggregated (partial + final) and scans two columns
    p = plans["order_listing"]
    assert "HashAggregate" in p
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>", p)


@pytest.fixture(scope="module")
def shuffled(spark):
    """Plans as a large input would get them: no broadcast joins."""
    qs = E.queries()
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return {k: _plan(qs[k](spark, SF)) for k in (
            "join_semi", "in_subquery", "dashboard_kpis", "recent_orders", "order_listing",
            "purchase_history", "menu_delete", "delete_restrict")}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_no_cross_join_and_no_broadcast_hint(shuffled):
    for k, p in shuffled.items():
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, k
        assert "BroadcastExchange" not in p, k


def test_child_keys_are_distinct_before_they_shuffle(shuffled):
    # the order lines of a semi join are folded to one row per key and task first
    p = shuffled["join_semi"]
    assert re.search(r"HashAggregate[\s\S]*Exchange", p)
    assert p.count("HashAggregate") >= 2
