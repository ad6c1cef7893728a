"""Sharding (7) by longest-processing-time scheduling.

Documents of equal text form a group that stays together.  Groups, largest
first, go to the least-loaded shard through a heap.  The heap does not see every
group: groups of 1/TARGET of all bytes or more are scheduled one by one (there
are at most TARGET of them), smaller ones in bundles of about equal size made of
groups of one size class, so the number of scheduled items is bounded
whatever the number of documents.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.llm.text import only
from larder.session import cut_lineage

SHARDS = 16
TARGET = 16384            # a bundle holds about 1/TARGET of all bytes
CLASSES = 32              # size classes per doubling


def longest_first(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Item -> shard: by size, largest first (ties by key), each to the
    least-loaded shard (ties: lowest number)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heap[0]
        out[key] = s
        heapq.heapreplace(heap, (load + size, s))
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, grp): UTF-8 bytes plus 1, the checksum (null text:
    as empty) and the group: SHA-256 of the text, ``null`` for null texts."""
    d = only(docs, doc_id=id_col, text=text_col)
    raw = F.col("text").cast("binary")
    return d.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
                    F.coalesce(F.crc32(raw), F.lit(0).cast("long")).alias("text_crc32"),
                    F.coalesce(F.sha2(raw, 256), F.lit("null")).alias("grp"))


def assign(rows: DataFrame, shards: int = SHARDS, target: int = TARGET) -> DataFrame:
    """``rows(grp, size, ...)`` with ``shard``; shard sizes are as near to equal as
    bundles allow (a bundle is 1/``target`` of the bytes), unless one group is
    larger than a shard's share.

    Only size-class totals and bundle totals (at most about
    2 * target + CLASSES * 64 rows) reach the driver.
    """
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    groups = cut_lineage(groups.withColumn("cls", F.floor(F.log2("bytes") * CLASSES).cast("int")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    goal = max(1, total // target)
    per_class = groups.groupBy("cls").agg(F.sum("bytes").alias("b")).withColumn(
        "cut", F.ceil(F.col("b") / goal).cast("long")).select("cls", "cut")
    alone = F.col("bytes") >= goal
    named = groups.join(F.broadcast(per_class), "cls").select(           # at most 64 * CLASSES rows
        "grp", "bytes", F.when(alone, F.col("grp")).otherwise(
            F.concat_ws("/", "cls", F.pmod(F.xxhash64("grp"), "cut"))).alias("bundle"))
    items = [(r.bundle, r.b) for r in
             named.groupBy("bundle").agg(F.sum("bytes").alias("b")).toLocalIterator()]
    where = longest_first(items, shards)
    spark = rows.sparkSession
    table = spark.createDataFrame(list(where.items()) or [("", 0)], "bundle string, shard int")
    shard_of = named.join(F.broadcast(table), "bundle").select(F.col("grp").alias("_grp"), "shard")
    return rows.join(shard_of, F.col("grp") == F.col("_grp")).drop("_grp")


def numbered(rows: DataFrame, by: str = "shard", order: tuple[str, ...] = ("doc_id", "grp"),
             out: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each value of ``by``, without a window over a
    whole shard: rows are dealt to chunks by hash, numbered within (shard, chunk),
    and moved on by the sizes of the chunks before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = rows.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    inner = Window.partitionBy(by, "_chunk").orderBy(*order)
    d = d.withColumn("_at", F.row_number().over(inner) - 1)
    size = d.groupBy(by, "_chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    skip = size.select(F.col(by).alias("_by"), F.col("_chunk").alias("_c"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_skip"))
    d = d.join(skip, (F.col(by) == F.col("_by")) & (F.col("_chunk") == F.col("_c")))
    return d.withColumn(out, (F.col("_skip") + F.col("_at")).cast("long")).drop(
        "_chunk", "_at", "_by", "_c", "_skip")


def report(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (``bytes``), shard, slot,
    grown_shard (null: sizes, not the id, decide).  Null texts form one group,
    empty texts another; null ids and repeated rows keep rows and slots of their
    own; an empty table gives an empty result."""
    rows = cut_lineage(measured(docs, id_col, text_col))
    d = numbered(cut_lineage(assign(rows, shards)))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write ``docs`` as Parquet, one folder ``shard=k`` per shard under ``path``.

    Rows meet their shard by the group's digest; a shard's rows come from many
    tasks, so no task holds a shard.  Columns named like the operator's own
    (``shard``, ``__grp``) are replaced.
    """
    raw = F.col(text_col).cast("binary")
    tagged = docs.withColumn("__grp", F.coalesce(F.sha2(raw, 256), F.lit("null")))
    rows = cut_lineage(measured(docs, id_col, text_col))
    of = assign(rows, shards).select(F.col("grp").alias("__grp"), "shard").distinct()
    tagged.drop("shard").join(of, "__grp").drop("__grp").write.partitionBy("shard").mode("overwrite").parquet(path)
