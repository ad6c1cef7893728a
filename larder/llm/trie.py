"""Conversation prefix trie by time-forward processing (13).

Conversations are sorted by range over the cluster, so a long one lies in several
tasks; what one task hands to the next (how many turns, which prefix) is one
row per task.  A node is known by a hash of its turns that can be continued across
tasks (a polynomial over 128-bit turn digests).  Nodes are one aggregate over all
(conversation, depth) rows; a node's number is its smallest member with its depth.

Subtree totals go up by time-forward processing: the nodes of a shard are sorted by
reverse level order (Spark's external sort), each node takes its children's totals
from a priority queue that spills, and sends its own to its parent.  A shard is the
subtree below the first node with at most ``light`` members (split by depth bands); its
root's totals are added up per parent in Spark and go into the pass over the few
heavy nodes above.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.text import only, stored

GROUP, HEADS = 100, 6        # fixed values of the contract: c - c%100 and crc32(c) % 6
LIGHT = 32                   # members of a shard root at most (or a 1/4,096 of all conversations)
HEAVY_SHARE = 4096           # so at most this many heavy nodes a level
BAND = 1 << 20               # levels that one shard may have
QUEUE = 1 << 17              # messages that a queue holds in memory
PIECE = 1 << 16              # bytes of ids in one row

_P = (1 << 127) - 1
_B = 0x5BD1E995_9E3779B9_7F4A7C15_85EBCA6B
ROOT = bytes(16)


# ------------------------------------------------------------------ queue

class SpillingQueue:
    """Priority queue of (level, node, leaves, saved) messages, smallest first.  What
    does not fit in memory goes as sorted runs to unnamed files of the task, as a sort
    spills; runs are merged when there are many."""

    _ITEM = ">q16sqq"

    def __init__(self, limit: int = QUEUE, most_runs: int = 16):
        self.limit, self.most_runs = limit, most_runs
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []         # (next item, number of the run)
        self.runs: dict[int, Iterator[tuple]] = {}
        self.made = self.spilled = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self.heap.sort()
            self._write(iter(self.heap))
            self.heap = []
            if len(self.runs) > self.most_runs:
                rest = [heapq.merge([head], self.runs[k]) for head, k in self.heads]
                self.runs, self.heads = {}, []
                self._write(heapq.merge(*rest))

    def _write(self, items: Iterator[tuple]) -> None:
        f = tempfile.TemporaryFile()
        for x in items:
            f.write(struct.pack(self._ITEM, *x))
            self.spilled += 1
        f.seek(0)
        run, self.made = self._read(f), self.made + 1
        self.runs[self.made] = run
        heapq.heappush(self.heads, (next(run), self.made))

    def _read(self, f) -> Iterator[tuple]:
        with f:
            while data := f.read(struct.calcsize(self._ITEM) * 1024):
                yield from struct.iter_unpack(self._ITEM, data)

    def peek(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        item = self.peek()
        if self.heads and item is self.heads[0][0]:
            k = heapq.heappop(self.heads)[1]
            nxt = next(self.runs[k], None)
            if nxt is None:
                del self.runs[k]
            else:
                heapq.heappush(self.heads, (nxt, k))
            return item
        return heapq.heappop(self.heap)


def time_forward(batches: Iterator[pa.RecordBatch], limit: int = QUEUE) -> Iterator[pa.RecordBatch]:
    """Nodes in reverse level order (deepest first, then key) with what other shards
    sent them -> the same rows with n_children, n_leaves and saved_tokens of their
    subtrees.  A node whose ``top`` is true sends nothing: its parent is elsewhere."""
    queue = SpillingQueue(limit)
    for b in batches:
        c = {name: b.column(name).to_pylist() for name in
             ("key", "pkey", "depth", "n_convs", "cp", "top", "in_children", "in_leaves", "in_saved")}
        children, leaves, saved = [], [], []
        for key, pkey, depth, n, cp, top, k, below, total in zip(*c.values()):
            while (m := queue.peek()) is not None and m[0] == -depth and m[1] == key:
                queue.pop()
                k, below, total = k + 1, below + m[2], total + m[3]
            if k == 0:
                below = 1
            total += (n - 1) * cp
            if not top:
                queue.push((1 - depth, pkey, below, total))
            children.append(k)
            leaves.append(below)
            saved.append(total)
        keep = [n for n in b.schema.names if not n.startswith("in_")]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(n) for n in keep], *[pa.array(x, pa.int64()) for x in (children, leaves, saved)]],
            names=[*keep, "n_children", "n_leaves", "saved_tokens"])


# ------------------------------------------------------------- sorted passes

def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by_range(df: DataFrame, *order) -> DataFrame:
    return df.repartitionByRange(_parts(df), *order).sortWithinPartitions(*order)


def _crossing(df: DataFrame, value: str) -> list[tuple[int, int, list]]:
    """(task, conversation, ``value`` at the end of each task it was in before) of
    conversations that go on from one task of a sorted pass to the next; one row per task
    comes to the driver."""
    ends = (df.groupBy("pid").agg(F.min("conv").alias("first"), F.max("conv").alias("last"),
                                  F.max_by(value, F.struct("conv", "pos")).alias("v"))
              .orderBy("pid").collect())
    out: list[tuple[int, int, list]] = []
    for a, b in zip(ends, ends[1:]):
        if a["last"] == b["first"]:
            before = out[-1][2] if out and out[-1][0] == a["pid"] and a["first"] == a["last"] else []
            out.append((b["pid"], b["first"], [*before, a["v"]]))
    return out


def _ranked(df: DataFrame, order: list) -> DataFrame:
    """Rows (conv, digest, cp) with ``pos``, their place in the conversation by ``order``."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, conv, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            ids = np.asarray(b.column("conv"))
            if not len(ids):
                continue
            head = np.concatenate([[ids[0] != conv], ids[1:] != ids[:-1]])
            at = np.arange(len(ids))
            start = np.maximum.accumulate(np.where(head, at, 0))
            pos = at - start + 1
            if not head[0]:
                pos[start == 0] += n
            conv, n = ids[-1], int(pos[-1])
            yield pa.RecordBatch.from_arrays(
                [b.column("conv"), pa.array(pos), b.column("digest"), b.column("cp"),
                 pa.array(np.full(len(ids), pid, np.int64))], names=["conv", "pos", "digest", "cp", "pid"])
    rows = stored(_by_range(df, "conv", *order).mapInArrow(
        number, "conv long, pos long, digest binary, cp long, pid long"), "trie-turns")
    moves = [(pid, conv, sum(v)) for pid, conv, v in _crossing(rows, "pos")]
    if not moves:
        return rows.drop("pid")
    shift = df.sparkSession.createDataFrame(moves, "pid long, conv long, _s long")   # one row per task at most
    return (rows.join(F.broadcast(shift), ["pid", "conv"], "left")
                .select("conv", (F.col("pos") + F.coalesce("_s", F.lit(0))).alias("pos"), "digest", "cp"))


def _joined(before: bytes, n: int, key: bytes) -> bytes:
    """Hash of a sequence with hash ``before``, then ``n`` turns with hash ``key``."""
    return ((int.from_bytes(before) * pow(_B, n, _P) + int.from_bytes(key)) % _P).to_bytes(16)


def _prefixes(df: DataFrame) -> DataFrame:
    """Rows (conv, kind, pos, digest, cp) in order of (kind, pos) -> (conv, depth, key,
    pkey, cp): hashes of the turns up to here, and up to the one before."""
    schema = "conv long, pos long, key binary, pkey binary, cp long, pid long"

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, conv, n, h = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            pos, keys, before = [], [], []
            for c, digest in zip(b.column("conv").to_pylist(), b.column("digest").to_pylist()):
                if c != conv:
                    conv, n, h = c, 0, 0
                before.append(h.to_bytes(16))
                n, h = n + 1, (h * _B + int.from_bytes(digest)) % _P
                pos.append(n)
                keys.append(h.to_bytes(16))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv"), pa.array(pos, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(before, pa.binary()), b.column("cp"), pa.array([pid] * len(pos), pa.int64())],
                names=["conv", "pos", "key", "pkey", "cp", "pid"])
    rows = stored(_by_range(df, "conv", "kind", "pos").mapInArrow(chain, schema), "trie-prefixes")
    out = rows.withColumnRenamed("pos", "depth").drop("pid")
    ends = _crossing(rows.select("conv", "pos", "pid", F.struct("pos", "key").alias("end")), "end")
    if not ends:
        return out
    carry = {}
    for pid, conv, v in ends:
        n, key = 0, ROOT
        for e in v:
            n, key = n + e["pos"], _joined(key, e["pos"], bytes(e["key"]))
        carry[pid] = (n, key)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, keys, before = [], [], []
            for p, key, pkey, pid in zip(*[b.column(c).to_pylist() for c in ("pos", "key", "pkey", "pid")]):
                n, start = carry[pid]
                pos.append(n + p)
                keys.append(_joined(start, p, key))
                before.append(_joined(start, p - 1, pkey))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv"), pa.array(pos, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(before, pa.binary()), b.column("cp")], names=["conv", "depth", "key", "pkey", "cp"])
    cut = F.broadcast(df.sparkSession.createDataFrame([(p, c) for p, c, _ in ends], "pid long, conv long"))
    moved = rows.join(cut, ["pid", "conv"], "left_semi").select(*rows.columns)
    kept = rows.join(cut, ["pid", "conv"], "left_anti").select(*rows.columns)
    return kept.withColumnRenamed("pos", "depth").drop("pid").unionByName(
        moved.mapInArrow(go_on, "conv long, depth long, key binary, pkey binary, cp long"))


def _ends(last: DataFrame) -> DataFrame:
    """(key, ends_sha256) of conversations (conv, key) that end at a node.  Ids are sorted
    and joined by range over the cluster in pieces of 64 KB; a digest has to read its
    pieces in order, one after the other, and holds none of them."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, ids, size = None, 0, [], 0

        def row():
            return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "at": pa.array([at], pa.int64()),
                                               "ids": pa.array([",".join(ids)])})
        for b in batches:
            out = []
            for k, c in zip(b.column("key").to_pylist(), b.column("conv").to_pylist()):
                if k != key or size > PIECE:
                    if ids:
                        out.append(row())
                    key, at, ids, size = k, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if ids:
            yield row()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None

        def batch(keys, found):
            return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(found, pa.string())})
        for b in batches:
            keys, found = [], []
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
                if k != key:
                    if h is not None:
                        keys.append(key)
                        found.append(h.hexdigest())
                    key, h = k, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield batch(keys, found)
        if h is not None:
            yield batch([key], [h.hexdigest()])
    parts = _by_range(last, "key", "conv").mapInArrow(pieces, "key binary, at long, ids string")
    return (parts.repartition(_parts(last), "key").sortWithinPartitions("key", "at")
                 .mapInArrow(digests, "key binary, ends_sha256 string"))


# -------------------------------------------------------------------- trie

def turns(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role",
          text_col="text") -> DataFrame:
    """(conv, pos, digest, cp): turns in order with a 128-bit digest of role and text and
    the text's code points.  Null ids are no conversations.  Turns of equal number (also
    null, which comes first) go by role, then text (its first 64 characters, then
    the digest); repeated rows are turns of their own."""
    t = only(conversations, conv=conversations[conv_col].cast("long"), turn=turn_col,
             role=F.coalesce(conversations[role_col].cast("string"), F.lit("")),
             text=F.coalesce(conversations[text_col].cast("string"), F.lit("")))
    t = t.filter(F.col("conv").isNotNull()).select(
        "conv", "turn", F.substring("role", 1, 64).alias("role"), F.substring("text", 1, 64).alias("start"),
        F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)), 1, 16).alias("digest"),
        F.length("text").cast("long").alias("cp"))
    return _ranked(t, [F.col("turn").asc_nulls_first(), "role", "start", "digest"])


def rebuilt(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with turns (conv), rows (conv, kind, pos, digest, cp)): the first h
    turns of conversation c - c%100 and c's own turns after its first h."""
    c = t.select("conv").distinct().select(
        "conv", (F.col("conv") - F.col("conv") % GROUP).alias("base"),
        (F.crc32(F.col("conv").cast("string")) % HEADS).alias("h"))
    first = t.filter((F.col("conv") % GROUP == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv", "base")
    heads = (c.join(first, "base").filter(F.col("pos") <= F.col("h"))
              .select("conv", F.lit(0).alias("kind"), "pos", "digest", "cp"))
    own = (t.filter(F.col("pos") > F.crc32(F.col("conv").cast("string")) % HEADS)
            .select("conv", F.lit(1).alias("kind"), "pos", "digest", "cp"))
    return c.select("conv"), heads.unionByName(own)


def nodes(convs: DataFrame, rows: DataFrame, light: int | None = None, band: int = BAND,
          queue: int = QUEUE) -> DataFrame:
    """The trie of prefix rows (conv, depth, key, pkey, cp) and conversations (conv), one
    row per node.  ``light``, ``band`` and ``queue`` change how the work is cut, never a result."""
    rows = rows.unionByName(convs.select(
        "conv", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"),
        F.lit(None).cast("binary").alias("pkey"), F.lit(0).cast("long").alias("cp")))
    n = stored(rows.groupBy("key").agg(
        F.min("depth").alias("depth"), F.min("pkey").alias("pkey"), F.min("cp").alias("cp"),
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")), "trie-nodes")
    ends = _ends(rows.groupBy("conv").agg(F.max_by("key", "depth").alias("key")))
    total, deepest = n.agg(F.max("n_convs"), F.max("depth")).first()
    if total is None:
        total = deepest = 0
    if light is None:
        light = max(LIGHT, -(-total // HEAVY_SHARE))
    parent = n.select(F.col("key").alias("pkey"), F.col("conv_id").alias("parent_conv_id"))
    full = (n.join(parent, "pkey", "left").join(ends, "key", "left")
             .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
             .withColumn("_band", F.floor(F.col("depth") / band)))
    # the shard of a light node: the first light node of its band on its smallest member's way
    small = n.filter(F.col("n_convs") <= light)
    shards = (rows.select("conv", "depth", "key").join(small.select("key"), "key")
                  .groupBy(F.col("conv").alias("conv_id"), F.floor(F.col("depth") / band).alias("_band"))
                  .agg(F.min_by("key", "depth").alias("shard")))
    full = stored(full.join(shards, ["conv_id", "_band"], "left"), "trie-shards")
    is_light = F.col("n_convs") <= light
    deepest_light = full.filter(is_light).agg(F.max("_band")).first()[0]

    def sent(to: DataFrame, ups: list[DataFrame]) -> DataFrame:
        """``to`` with what the shard roots below sent, added up per parent."""
        if not ups:
            return to.withColumns({c: F.lit(0).cast("long") for c in ("in_children", "in_leaves", "in_saved")})
        up = ups[0]
        for u in ups[1:]:
            up = up.unionByName(u)
        up = up.groupBy(F.col("pkey").alias("_to")).agg(
            F.count(F.lit(1)).alias("_c"), F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        return to.join(up, to["key"] == up["_to"], "left").select(
            *to.columns, F.coalesce("_c", F.lit(0)).cast("long").alias("in_children"),
            F.coalesce("_l", F.lit(0)).cast("long").alias("in_leaves"),
            F.coalesce("_s", F.lit(0)).cast("long").alias("in_saved"))

    cols = ["key", "pkey", "conv_id", "depth", "parent_conv_id", "n_convs", "cp", "ends_sha256", "top"]
    done, ups = [], []
    schema = ("key binary, pkey binary, conv_id long, depth long, parent_conv_id long, n_convs long, cp long, "
              "ends_sha256 string, top boolean, n_children long, n_leaves long, saved_tokens long")

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return time_forward(batches, queue)

    for b in range(deepest_light if deepest_light is not None else -1, -1, -1):
        part = full.filter(is_light & (F.col("_band") == b)).withColumn("top", F.col("key") == F.col("shard"))
        # a root with heavy parent, or with its parent in the band above, is its shard's own top
        part = sent(part.select(*cols, "shard"), ups[-1:])
        part = part.repartition(_parts(n), "shard").drop("shard").sortWithinPartitions(F.desc("depth"), "key")
        got = stored(part.mapInArrow(forward, schema), "trie-light")
        done.append(got)
        ups.append(got.filter("top"))
    heavy = full.filter(~is_light).withColumn("top", F.col("pkey").isNull()).select(*cols)
    heavy = sent(heavy, ups).repartition(1).sortWithinPartitions(F.desc("depth"), "key")
    out = heavy.mapInArrow(forward, schema)
    for d in done:
        out = out.unionByName(d)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      "ends_sha256")


def report(conversations: DataFrame, **limits) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations (none for an empty
    table, the root at least otherwise)."""
    convs, rows = rebuilt(turns(conversations))
    return nodes(convs, _prefixes(rows), **limits)


def sql(conversations: str = "conversations") -> str:
    """DuckDB SQL for ``report``: nodes by all their turns, subtrees by joining every
    node with the prefixes of its smallest member."""
    return f"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM {conversations} WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS k, 4294967295::BIGINT AS c FROM (SELECT DISTINCT conv_id FROM t)
  UNION ALL
  SELECT conv_id, s, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(c, ord(s[k // 8 + 1])::BIGINT) ELSE c END AS x FROM crc
        WHERE k < 8 * length(s))),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(c, 4294967295::BIGINT) % 6 AS h FROM crc WHERE k = 8 * length(s)),
u AS (SELECT c.conv_id, 0 AS kind, b.pos, b.role, b.text FROM c JOIN t b ON b.conv_id = c.base AND b.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
r AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS cp,
             sha256(string_agg(sha256(role) || sha256(text), '') OVER w) AS key
      FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY kind, pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT key, min(depth) AS depth, min(cp) AS cp, count(*) AS n_convs, min(conv_id) AS conv_id FROM r GROUP BY key),
p AS (SELECT n.key, a.conv_id AS parent_conv_id, a.key AS pkey
      FROM n JOIN r ON r.conv_id = n.conv_id AND r.depth = n.depth - 1 JOIN n a ON a.key = r.key),
k AS (SELECT pkey, count(*) AS n_children FROM p GROUP BY pkey),
m AS (SELECT n.*, p.parent_conv_id, coalesce(k.n_children, 0) AS n_children
      FROM n LEFT JOIN p ON p.key = n.key LEFT JOIN k ON k.pkey = n.key),
s AS (SELECT r.key, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.cp) AS saved_tokens
      FROM m JOIN r ON r.conv_id = m.conv_id AND r.depth <= m.depth GROUP BY r.key),
e AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
      FROM (SELECT conv_id, max_by(key, depth) AS key FROM r GROUP BY conv_id) GROUP BY key)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, m.parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs,
       CAST(m.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM m JOIN s ON s.key = m.key LEFT JOIN e ON e.key = m.key"""
