"""Referential actions as a graph (U9-U11): a delete from any table, with everything
that the declared foreign keys ask for, as one statement that happens whole or not at all.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.quality import FOREIGN_KEYS

CASCADE, SET_NULL, RESTRICT = "cascade", "set null", "restrict"

# Fixed rules of the reference schema: what a delete of the parent does to (child, column).
ACTIONS: dict[tuple[str, str], str] = {
    ("ingredients", "supplier_id"): SET_NULL,
    ("purchases", "supplier_id"): RESTRICT,
    ("purchases", "ingredient_id"): RESTRICT,
    ("recipes", "menu_id"): CASCADE,
    ("recipes", "ingredient_id"): RESTRICT,
    ("orders", "customer_id"): SET_NULL,
    ("orders", "employee_id"): RESTRICT,
    ("order_items", "order_id"): CASCADE,
    ("order_items", "menu_id"): RESTRICT,
    ("users", "customer_id"): CASCADE,
}


@dataclass
class Edge:
    child: str
    col: str
    parent: str
    parent_col: str
    action: str


def schema_graph() -> list[Edge]:
    """The ten foreign keys with their actions."""
    return [Edge(c, col, p, pc, ACTIONS[c, col]) for c, col, p, pc in FOREIGN_KEYS]


def in_order(graph: list[Edge], table: str) -> list[str]:
    """Tables that a delete from ``table`` can remove rows of, parents before children.
    ValueError if cascades lead back to a table."""
    below: dict[str, set[str]] = {}
    for e in graph:
        if e.action == CASCADE:
            below.setdefault(e.parent, set()).add(e.child)
    out: list[str] = []
    state: dict[str, int] = {}

    def visit(t: str) -> None:
        if state.get(t) == 1:
            raise ValueError(f"cascades lead back to {t}")
        if t not in state:
            state[t] = 1
            for c in sorted(below.get(t, ())):
                visit(c)
            state[t] = 2
            out.append(t)
    visit(table)
    return out[::-1]


@dataclass
class Deletion:
    """``tables``: every table that the statement touches, as it is after it (unchanged if it is
    refused); ``gone``: the rows that go, per table; ``refused``: (child, column, rows that refer), no
    rows if the statement goes through."""
    tables: dict[str, DataFrame]
    refused: DataFrame
    gone: dict[str, DataFrame] = field(default_factory=dict)


def delete_where(tables: dict[str, DataFrame], table: str, condition: Column | str,
                 graph: list[Edge] | None = None) -> Deletion:
    """DELETE FROM ``table`` WHERE ``condition`` under ``graph`` (the schema's by default).

    The graph is walked from parents to children: restricts are looked at before
    any cascade or set-null takes effect, over all tables that lose rows.  Distinct keys
    of the rows that go are joined with each child once (semi join, anti join or look-up),
    so a parent with many children shuffles as one key.
    """
    graph = schema_graph() if graph is None else graph
    condition = F.expr(condition) if isinstance(condition, str) else condition
    spark = tables[table].sparkSession
    doomed = {table: tables[table].filter(F.coalesce(condition, F.lit(False)))}
    order = in_order(graph, table)

    def keys(e: Edge) -> DataFrame:
        return doomed[e.parent].select(F.col(e.parent_col).alias("_key")).filter("_key IS NOT NULL").distinct()
    for t in order[1:]:
        into = [e for e in graph if e.child == t and e.action == CASCADE and e.parent in doomed and t in tables]
        if into:
            d = tables[t]
            for i, e in enumerate(into):
                d = _marked(d, e.col, keys(e), f"_hit{i}")
            doomed[t] = d.filter(reduce(lambda a, b: a | b, [F.col(f"_hit{i}") for i in range(len(into))])) \
                .select(*tables[t].columns)
    refusals = []
    for e in graph:
        if e.action == RESTRICT and e.parent in doomed and e.child in tables:
            refs = tables[e.child].select(F.col(e.col).alias("_key")).join(keys(e), "_key", "left_semi")
            refusals.append(refs.agg(F.count(F.lit(1)).alias("rows")).filter("rows > 0").select(
                F.lit(e.child).alias("child"), F.lit(e.col).alias("column"), "rows"))
    refused = reduce(DataFrame.unionByName, refusals) if refusals else \
        spark.createDataFrame([], "child string, column string, rows long")
    go = refused.agg(F.count(F.lit(1)) == 0).scalar()
    after = {}
    for t in tables:
        cascades = [e for e in graph if e.child == t and e.action == CASCADE and e.parent in doomed]
        nulls = [e for e in graph if e.child == t and e.action == SET_NULL and e.parent in doomed]
        if t != table and not cascades and not nulls:
            continue
        df = tables[t]
        if t == table:
            df = df.filter(~(F.coalesce(condition, F.lit(False)) & go))
        for e in cascades:
            df = df.join(keys(e).filter(go), F.col(e.col) == F.col("_key"), "left_anti")
        for e in nulls:
            df = _marked(df, e.col, keys(e).filter(go), "_gone")
            df = df.withColumn(e.col, F.when(~F.col("_gone"), F.col(e.col))).drop("_gone")
        after[t] = df.select(*tables[t].columns)
    return Deletion(after, refused, doomed)


def _marked(df: DataFrame, col: str, keys: DataFrame, mark: str) -> DataFrame:
    """``df`` with a boolean ``mark``: its ``col`` is among ``keys`` (_key)."""
    k = keys.select(F.col("_key").alias(f"{mark}_k"), F.lit(True).alias(f"{mark}_t"))
    return (df.join(k, F.col(col) == F.col(f"{mark}_k"), "left")
              .withColumn(mark, F.coalesce(F.col(f"{mark}_t"), F.lit(False))).drop(f"{mark}_k", f"{mark}_t"))
