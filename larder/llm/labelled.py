"""Labelled rows for the classifiers: join, bounded sample flag, one pass of statistics."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.text import HASHED_BYTES, batch_udf, block_ranges, give_back, only, remainder, remove
from larder.session import scratch_path

LONG_VALUE = 1 << 16   # sample values above so many bytes are a stratum of their own,
LONG_BYTES = 8 << 20   # of which a class gives so many bytes (one row at least), by smallest hash; the default
FILTER_BITS = 1 << 25  # bits of the filter of labelled ids


def maybe_labelled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs(id, ...)`` without most rows whose id is not in ``ids(id)``: a bitmap of
    FILTER_BITS hashed ids (4 MB, whatever the number of ids) is broadcast.  It
    only spares rows the shuffle of the join that follows; it never loses one.
    """
    word = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(word.alias("p")).groupBy((F.col("p") / 63).cast("int").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(p % 63 AS int)))").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 63 + 1, np.int64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        return lambda p: pa.array((held.value[p.to_numpy() // 63] >> (p.to_numpy() % 63)) & 1 == 1)
    return docs.filter(batch_udf("boolean", make, 1 << 16)(word))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int,
                  per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y, fit): every labelled row that is not held out.

    Rows with a null id, or a label that is neither 0 nor 1, are not labelled.  ``fit`` marks a
    sample of about ``per_class`` rows per class, chosen by a hash of the id:
    its size is bounded by the parameter, whatever the number of labels.
    """
    known = only(labels, id=id_col, y=F.col(label).cast("int")).filter(
        "id is not null and y in (0, 1)").filter(remainder("id", modulus) != held_out)
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("y") == 1, F.lit(per_class / max(n.get(1, 0), 1))).otherwise(
        F.lit(per_class / max(n.get(0, 0), 1)))
    point = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    known = known.withColumn("fit", point < share)
    d = only(docs, id=id_col, text=text_col).filter("id is not null")
    d = maybe_labelled(d, known.select("id"))
    # never a broadcast: the filter's Python worker and the one that reads the texts would then
    # run in one stage, two workers for each task
    return d.join(known.hint("merge"), "id").select(
        F.coalesce("text", F.lit("")).alias("text"), "y", "fit")


STATS = "slot int, n0 long, n1 long, y int, sample binary"


def statistics(rows: DataFrame, slots: int,
               features: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]],
               sample: Callable[[pa.Array], list[bytes]], long_bytes: int | None = None) -> tuple[np.ndarray, np.ndarray, list, "_Sample"]:
    """Documents per feature slot and class over all of ``rows`` (one pass), and
    the sample of the rows marked ``fit``.

    ``features`` gives a block's distinct (document, slot) pairs as two
    arrays.  Each task adds up its rows in two arrays of ``slots`` counts, so a task emits
    at most ``slots`` rows.  Returns counts[class, slot], documents per class,
    sample labels, sample values.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, slots), np.int64)
        docs = np.zeros(2, np.int64)
        for b in batches:
            text = b.column(0).cast(pa.large_string())
            y, fit = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            for lo, hi in block_ranges(text, HASHED_BYTES):
                part = text.slice(lo, hi - lo)
                doc, slot = features(part)
                of = y[lo:hi][doc]
                for c in (0, 1):
                    counts[c] += np.bincount(slot[of == c], minlength=slots)
                    docs[c] += int((y[lo:hi] == c).sum())
            few = np.flatnonzero(fit)
            chosen = text.take(pa.array(few))
            for lo, hi in block_ranges(chosen, HASHED_BYTES):
                m = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                     pa.array(y[few[lo:hi]], pa.int32()), pa.array(sample(chosen.slice(lo, m)), pa.binary())],
                    names=["slot", "n0", "n1", "y", "sample"])
            give_back()
        at = np.flatnonzero(counts.sum(axis=0))
        slot = np.concatenate([at, [-1]])
        n0, n1 = (np.concatenate([counts[c][at], [docs[c]]]) for c in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot, pa.int32()), pa.array(n0), pa.array(n1),
             pa.nulls(len(slot), pa.int32()), pa.nulls(len(slot), pa.binary())],
            names=["slot", "n0", "n1", "y", "sample"])
    # both parts are read once, so they are written once, and removed after
    path = scratch_path(rows.sparkSession, f"labelled-{uuid.uuid4().hex}")
    rows.mapInArrow(run, STATS).write.parquet(path)
    out = rows.sparkSession.read.parquet(path)
    t = out.filter("slot is not null").groupBy("slot").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    slot = t.column("slot").to_numpy()
    n = np.stack([t.column("n0").to_numpy(), t.column("n1").to_numpy()])
    counts = np.zeros((2, slots), np.int64)
    counts[:, slot[slot >= 0]] = n[:, slot >= 0]
    docs = n[:, slot == -1].sum(axis=1)
    few = _Sample(out.filter("y is not null"), LONG_BYTES if long_bytes is None else long_bytes)
    remove(rows.sparkSession, path)
    return counts, docs, few.y, few


class _Sample:
    """The sample's values in one flat buffer: no object per row, read where it is used."""

    def __init__(self, rows: DataFrame, long_bytes: int):
        """``rows`` (y, sample): all values up to LONG_VALUE bytes, and of the longer ones those
        with the smallest hashes, ``long_bytes`` a class (one row at least).  Their order does
        not depend on the order of arrival."""
        r = rows.select("y", "sample", F.octet_length("sample").cast("long").alias("size"),
                        F.xxhash64("sample").alias("h"))
        first = Window.partitionBy("y").orderBy("h", "sample")        # at most the sample's rows of a class
        long = (r.filter(F.col("size") > LONG_VALUE)
                 .withColumn("k", F.row_number().over(first))
                 .withColumn("sum", F.sum("size").over(first.rowsBetween(Window.unboundedPreceding, 0)))
                 .filter((F.col("sum") <= long_bytes) | (F.col("k") == 1)).select(*r.columns))
        taken = r.filter(F.col("size") <= LONG_VALUE).unionByName(long).orderBy("y", "h", "sample")
        self.y: list[int] = []
        data, offs = bytearray(), [0]
        for y, sample in taken.select("y", "sample").toLocalIterator():
            self.y.append(y)
            data += sample
            offs.append(len(data))
        self.data, self.offs = data, offs

    def __len__(self) -> int:
        return len(self.y)

    def __getitem__(self, i: int) -> memoryview:
        return memoryview(self.data)[self.offs[i]:self.offs[i + 1]]


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights and bias (last) of a logistic regression, by Newton steps with a
    small ridge; ``x`` has one row per case."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
