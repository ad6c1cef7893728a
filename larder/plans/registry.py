"""Registry of named queries: key -> (job over the stand-in tables, oracle SQL).

A job takes a ``Tables`` (lazy restaurant tables over one driver directory)
and returns a DataFrame.  For the oracle comparison, decimal outputs are cast
to double and DATE outputs to a midnight TIMESTAMP at the very end (the
oracle casts the same way; both render identically in every client); the
jobs themselves compute in exact decimals and return DATE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.plans.oracle_sql import with_prefix
from larder.sources.testdata import Tables, from_driver

JOBS: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None, extra_ctes: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``key`` with its oracle SELECT."""
    def deco(fn):
        if key in JOBS:
            raise ValueError(f"duplicate key {key}")
        JOBS[key] = fn
        if sql is not None:
            SQL[key] = with_prefix(sql, extra_ctes)
        return fn
    return deco


def for_compare(df: DataFrame) -> DataFrame:
    def conv(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return c.cast("timestamp_ntz").alias(f.name)
        return c
    return df.select(*[conv(f) for f in df.schema.fields])


def _load_all() -> None:
    # importing the plan modules fills JOBS / SQL
    from larder.plans import audits, change_jobs, reports, stock_jobs  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()

    def bind(fn):
        return lambda spark, sf_dir: for_compare(fn(from_driver(spark, sf_dir)))
    return {k: bind(fn) for k, fn in JOBS.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(SQL)
