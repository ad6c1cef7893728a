"""INSERT, UPDATE and DELETE over a store of tables (S7 with 2.10).

Spark parses the statement; its parts become the change jobs of this library:
deletes walk the foreign keys (``operators.referential``), new and changed rows are
checked against the rules and keys (``operators.quality``), missing ids are given out (W2), and
the tables change in one commit (S9).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import quality as Q
from larder.operators.referential import delete_where
from larder.operators.windows import assign_ids
from larder.schemas import DEFAULTS, SCHEMAS, conform
from larder.session import cut_lineage
from larder.sources.commits import Snapshot, Store


class StatementRefused(ValueError):
    """The statement breaks a rule or a key, or has a form that is not supported."""


@dataclass
class Changed:
    """The table after the statement and the number of rows that it inserted, updated or deleted
    (rows that went or changed in other tables by foreign keys are not counted)."""
    table: str
    frame: DataFrame
    rows: int


def parse(spark, sql: str):
    """Spark's own parsed plan of a statement."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def is_change(plan) -> bool:
    """True if the plan changes table data."""
    return plan.getClass().getSimpleName() in ("InsertIntoStatement", "UpdateTable", "DeleteFromTable", "MergeIntoTable")


def run(store: Store, sql: str, attempts: int = 5) -> Changed:
    """Run one INSERT, UPDATE or DELETE on the newest tables of the store; all of it is visible
    at once, or nothing is and StatementRefused says why.  If another writer changed the
    tables meanwhile, it runs again on what that one left."""
    plan = parse(store.spark, sql)
    kind = plan.getClass().getSimpleName()
    jobs = {"InsertIntoStatement": _insert, "UpdateTable": _update, "DeleteFromTable": _delete}
    if kind not in jobs:
        raise StatementRefused(f"{kind} is not supported: INSERT, UPDATE or DELETE are")
    table, changed = _target(plan), []

    def job(s: Snapshot) -> dict:
        if table not in s.tables:
            raise StatementRefused(f"no table {table}")
        if table not in SCHEMAS:
            raise StatementRefused(f"table {table} has no declared schema")
        commit, rows = jobs[kind](s, table, plan)
        changed.append(rows)
        return commit
    store.transact(job, attempts)
    return Changed(table, store.read(table), changed[-1])


def _target(plan) -> str:
    relation = plan.table()
    if relation.getClass().getSimpleName() == "SubqueryAlias":
        raise StatementRefused("an alias of the changed table is not supported")
    names = relation.multipartIdentifier()
    if names.length() != 1:
        raise StatementRefused("name the table without a catalog")
    return names.apply(0).lower()


def _tables(s: Snapshot) -> dict[str, DataFrame]:
    return {t: s.read(t) for t in s.tables if t in SCHEMAS}


def _check(rows: DataFrame, table: str, stored: dict[str, DataFrame]) -> None:
    broken = Q.append_violations(rows, table, stored).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()
    if broken:
        raise StatementRefused("; ".join(sorted(f"{r['rule']}: {r['n']} rows" for r in broken)))


def _insert(s: Snapshot, table: str, plan) -> tuple[dict, int]:
    if plan.overwrite() or not plan.partitionSpec().isEmpty():
        raise StatementRefused("INSERT OVERWRITE and PARTITION are not supported")
    spark = s.store.spark
    query = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.query()), spark)
    named = [plan.userSpecifiedCols().apply(i).lower() for i in range(plan.userSpecifiedCols().length())]
    columns = named or SCHEMAS[table].names
    if len(columns) != len(query.columns) or len(set(columns)) < len(columns):
        raise StatementRefused(f"{len(query.columns)} values for {len(columns)} columns")
    if unknown := sorted(set(columns) - set(SCHEMAS[table].names)):
        raise StatementRefused(f"no column {', '.join(unknown)} in {table}")
    rows = query.toDF(*columns)
    key, last = Q.PRIMARY_KEY[table], {}
    if len(key) == 1 and key[0] not in columns:
        first = s.next_id(table, key[0])
        rows = assign_ids(rows.withColumn("_at", F.monotonically_increasing_id()), ["_at"], start=first, out=key[0]).drop("_at")
    rows = cut_lineage(conform(rows, table))
    n = rows.count()
    _check(rows, table, _tables(s))
    if len(key) == 1:
        given = rows.agg(F.max(key[0])).first()[0]
        if given is not None:
            last[table] = max(given, s.next_id(table, key[0]) - 1)
    return {"append": {table: rows}, "last_ids": last}, n


def _update(s: Snapshot, table: str, plan) -> tuple[dict, int]:
    tables = _tables(s)
    df = tables[table]
    sets = {}
    for i in range(plan.assignments().length()):
        a = plan.assignments().apply(i)
        sets[a.key().sql().strip("`").lower()] = a.value().sql()
    if unknown := sorted(set(sets) - set(df.columns)):
        raise StatementRefused(f"no column {', '.join(unknown)} in {table}")
    if keys := sorted({pc for _, _, p, pc in Q.FOREIGN_KEYS if p == table} & set(sets)):
        raise StatementRefused(f"{', '.join(keys)}: other tables may refer to it")
    hit = F.coalesce(F.expr(plan.condition().get().sql()), F.lit(False)) if plan.condition().isDefined() else F.lit(True)
    types = {f.name: f.dataType for f in SCHEMAS[table].fields}

    def value(c: str):
        text = DEFAULTS.get(table, {}).get(c) if sets[c].upper() == "DEFAULT" else None
        return (F.lit(text) if text is not None else F.expr(sets[c])).cast(types[c]).alias(c)
    changed = cut_lineage(df.filter(hit).select(*[value(c) if c in sets else F.col(c) for c in df.columns]))
    rest = df.filter(~hit)
    _check(changed, table, {**tables, table: rest})
    return {"replace": {table: rest.unionByName(changed)}}, changed.count()


def _delete(s: Snapshot, table: str, plan) -> tuple[dict, int]:
    d = delete_where(_tables(s), table, F.expr(plan.condition().sql()))
    refused = d.refused.collect()                         # one row per restricting foreign key
    if refused:
        raise StatementRefused("; ".join(f"{r['rows']} rows of {r['child']} refer to it by {r['column']}" for r in refused))
    # the highest id given out stays known when its row goes
    key = Q.PRIMARY_KEY[table]
    last = {table: s.next_id(table, key[0]) - 1} if len(key) == 1 else {}
    return {"replace": d.tables, "last_ids": last}, d.gone[table].count()
