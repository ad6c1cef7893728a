"""Sinks: append (S8) and atomic versioned snapshots.

Every attempt writes a folder of its own; only then does a commit record
(``larder.sources.commits``) name it.  Readers go by the records, so a half-written
attempt is never seen and data a reader may hold are never overwritten.
Everything goes through Spark's writers and its file-system access, so it
works on any shared file system the cluster names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from larder.sources import commits

ROWS = "rows"      # the one table of a store that is appended to by ``append``


def append(df: DataFrame, path: str, batch: str) -> int:
    """Append the rows of one batch (e.g. the accepted rows of a change job); the
    number of the commit.  A batch that is already committed adds nothing, so a
    retried append adds nothing twice; appends of several writers all count."""
    store = commits.Store(df.sparkSession, path)
    return store.commit(store.snapshot(), append={ROWS: df}, batch=batch)


def read_appended(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The rows of all committed batches."""
    snap = commits.Store(spark, path).snapshot()
    if schema is None:
        return snap.read(ROWS)
    folders = snap.tables[ROWS]["folders"]
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def _log(table_dir: str) -> str:
    return f"{table_dir}/_commits"


def commit_version(df: DataFrame, table_dir: str, version: int, batch: str | None = None) -> None:
    """Write ``df`` to a new folder and then record it as ``version``.

    Numbers rise.  A version that is already committed, or below the newest, is refused
    (ValueError), unless the same ``batch`` committed it (a retried job or micro-batch): then
    the committed data stay.  Of two writers who commit one version at the same
    time one gets it and the other is refused.
    """
    spark = df.sparkSession

    def refused(folder: str | None = None) -> bool:
        done = commits.read_record(spark, _log(table_dir), version)
        if done is None:
            newest = latest_version(spark, table_dir)
            if newest is None or newest < version:
                return False
        if folder is not None:
            commits.delete(spark, f"{table_dir}/{folder}")
        if done is not None and batch is not None and done["batch"] == batch:
            return True
        raise ValueError(f"version {version} of {table_dir} is already committed")
    if refused():
        return
    folder = f"data/v{version}-{uuid.uuid4().hex}"
    df.write.parquet(f"{table_dir}/{folder}")
    record = {"version": version, "folder": folder, "batch": batch}
    if not commits.put_if_absent(spark, commits.record_path(_log(table_dir), version), json.dumps(record)):
        refused(folder)


def latest_version(spark: SparkSession, table_dir: str, before: int | None = None) -> int | None:
    """Highest committed version (optionally below ``before``), or None."""
    n = [v for v in commits.numbers(spark, _log(table_dir)) if before is None or v < before]
    return n[-1] if n else None


def read_version(spark: SparkSession, table_dir: str, version: int) -> DataFrame:
    """A committed version."""
    record = commits.read_record(spark, _log(table_dir), version)
    if record is None:
        raise KeyError(f"no version {version} of {table_dir}")
    return spark.read.parquet(f"{table_dir}/{record['folder']}")


def read_latest(spark: SparkSession, table_dir: str, before: int | None = None) -> DataFrame | None:
    """S9 read side: the newest committed snapshot (or None)."""
    v = latest_version(spark, table_dir, before)
    return None if v is None else read_version(spark, table_dir, v)


def drop_old_versions(spark: SparkSession, table_dir: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` versions, records and data (returns their
    numbers).  Numbers rise, so theirs are never given again."""
    old = commits.numbers(spark, _log(table_dir))[:-keep]
    for v in old:
        record = commits.read_record(spark, _log(table_dir), v)
        commits.delete(spark, commits.record_path(_log(table_dir), v))
        commits.delete(spark, f"{table_dir}/{record['folder']}")
    return old
