"""Typed reads, seed loads, named views, table listing and statement runs
(S1-S7)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.aggregates import daily_sales
from larder.operators.joins import low_stock_supplier
from larder.schemas import DEFAULTS, SCHEMAS, conform
from larder.session import scratch_path
from larder.sources import commits, sinks, statements


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read a stored table with its declared schema (no inference); a
    partition column of the folder layout is left out.  A table that batches are
    appended to (S8) is read by its commit records."""
    if commits.exists(spark, f"{path}/_commits"):
        return sinks.read_appended(spark, path, SCHEMAS[table])
    return spark.read.schema(SCHEMAS[table]).parquet(path).select(*SCHEMAS[table].names)


def load_rows(spark: SparkSession, table: str, rows: list[dict]) -> DataFrame:
    """S3: literal rows; omitted columns take the declared default (or NULL).

    For fixtures and small reference data only — rows pass through the
    driver by design.
    """
    schema = SCHEMAS[table]
    defaults = DEFAULTS.get(table, {})
    full = [tuple(_coerce(r[f.name], f.dataType) if f.name in r
                  else _coerce(defaults.get(f.name), f.dataType) for f in schema.fields)
            for r in rows]
    raw = spark.createDataFrame(full, schema=_loose(schema))
    return conform(raw, table)


def _coerce(v, dtype):
    """Plain Python literals to the declared type (e.g. 0 -> Decimal('0'))."""
    from decimal import Decimal

    from pyspark.sql import types as T
    if v is None:
        return None
    if isinstance(dtype, T.DecimalType) and not isinstance(v, Decimal):
        return Decimal(str(v))
    return v


def _loose(schema):
    from pyspark.sql import types as T
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def register_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Expose each DataFrame as a temp view under its table name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """The reference's two named views as temp views.

    v_low_stock(name, quantity, unit, reorder_level, supplier) and
    v_daily_sales(day, total_orders, total_sales).  Catalyst inlines them
    into any query that reads them.
    """
    low_stock_supplier(tables["ingredients"], tables["suppliers"]) \
        .createOrReplaceTempView("v_low_stock")
    daily_sales(tables["orders"]).createOrReplaceTempView("v_daily_sales")


def catalog_tables(spark: SparkSession) -> list[str]:
    """Names of registered tables (views excluded: names starting 'v_'),
    sorted."""
    return sorted(t.name for t in spark.catalog.listTables()
                  if not t.name.startswith("v_"))


def split_statements(script: str) -> list[str]:
    """Split on ``;`` outside quotes and comments; empty pieces dropped.

    Comments are ``-- to the line's end`` and (nested) ``/* ... */``; inside
    quotes a doubled quote or a backslash keeps the quote open.
    """
    out, buf, quote, depth, i = [], [], None, 0, 0
    while i < len(script):
        ch, two = script[i], script[i:i + 2]
        if depth:
            step = 2 if two in ("/*", "*/") else 1
            depth += (two == "/*") - (two == "*/")
            i += step
            continue
        if quote:
            pair = (ch == "\\" and quote != "`" and len(two) == 2) or two == quote * 2
            buf.append(two if pair else ch)
            if not pair and ch == quote:
                quote = None
            i += 2 if pair else 1
            continue
        if two == "--":
            j = script.find("\n", i)
            i = len(script) if j < 0 else j
            continue
        if two == "/*":
            depth, i = 1, i + 2
            buf.append(" ")
            continue
        if ch == ";":
            out.append("".join(buf))
            buf = []
        else:
            quote = ch if ch in ("'", '"', "`") else None
            buf.append(ch)
        i += 1
    out.append("".join(buf))
    return [s.strip() for s in out if s.strip()]


@dataclass
class StatementResult:
    sql: str
    columns: list[str] | None = None
    frame: DataFrame | None = None
    error: str | None = None
    rows: int | None = None      # of an INSERT, UPDATE or DELETE


def sql_script(spark: SparkSession, script: str, store: commits.Store | None = None) -> list[StatementResult]:
    """Run ``;``-separated statements; each yields its rows or an error,
    and an error does not stop the later statements.  An empty script is an
    error.

    A statement with rows is run at once: its result is written to the shared
    scratch folder and read back, so run-time errors (a division by zero, a
    bad cast) belong to the statement that caused them.

    With a ``store``, statements see its newest tables, and INSERT, UPDATE and DELETE
    go to the change jobs (``larder.sources.statements``): their result is the table after
    them and the number of rows.
    """
    stmts = split_statements(script or "")
    if not stmts:
        return [StatementResult(sql="", error="empty statement")]
    results = []
    for s in stmts:
        try:
            if store is not None:
                snap = store.snapshot()
                register_tables(spark, {t: snap.read(t) for t in snap.tables})
                if statements.is_change(statements.parse(spark, s)):
                    done = statements.run(store, s)
                    results.append(StatementResult(s, done.frame.columns, done.frame, rows=done.rows))
                    continue
            df = spark.sql(s)
            columns = df.columns
            results.append(StatementResult(sql=s, columns=columns,
                                           frame=_stored(df) if columns else df))
        except Exception as e:  # noqa: BLE001 — reported per statement
            results.append(StatementResult(sql=s, error=f"{type(e).__name__}: {e}"))
    return results


def _stored(df: DataFrame) -> DataFrame:
    """``df`` as a written table (columns by position: names may repeat; untyped
    nulls become strings)."""
    columns = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(columns))])
    flat = flat.select(*[F.col(c).cast("string").alias(c) if t == "void" else F.col(c)
                         for c, t in flat.dtypes])
    path = scratch_path(df.sparkSession, f"statements/{uuid.uuid4().hex}")
    flat.write.parquet(path)
    return df.sparkSession.read.schema(flat.schema).parquet(path).toDF(*columns)


def run_bound(spark: SparkSession, sql: str, **args) -> DataFrame:
    """P13 as SQL: a statement with named parameters (``:name``) bound to
    values, as the reference's prepared statements do — values never go into
    the SQL text."""
    return spark.sql(sql, args=args)


def rows_of(df: DataFrame) -> DataFrame:
    """Row count of a statement's result as a frame (for the runner's footer)."""
    return df.agg(F.count(F.lit(1)).alias("rows"))
