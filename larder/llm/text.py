"""Block-wise text handling shared by the operators of this subpackage.

Spark hands Python Arrow batches; the helpers cut a batch into blocks of a few
megabytes of text (a longer text is a block of its own, never cut), and work
on the block's UTF-8 bytes with numpy: word spans, 64-bit span hashes, counts
per document.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import scratch_path

BLOCK_BYTES = 1 << 20     # spans and hashes take 25 to 150 times a block's bytes in a worker
HASHED_BYTES = 1 << 19    # of blocks whose every word and window is hashed and sorted

# fixed byte classes of the contracts
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NON_SPACE = ~_SPACE                       # words [^\x20\x09-\x0D]+
WORD_CHARS = np.zeros(256, bool)          # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
WORD_CHARS[0x30:0x3A] = True
WORD_CHARS[0x61:0x7B] = True
WORD_CHARS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)    # A-Z to a-z, all else as it is
LOWER[0x41:0x5B] += 32


def block_udf(return_type: str, make: Callable[[], Callable[[pa.Array], pa.Array]],
              block_bytes: int = BLOCK_BYTES):
    """A column function over one text column, evaluated block by block.

    ``make`` runs once per task (models are unpacked there) and returns a
    function from a block's string array (nulls kept) to a result array of the
    same length.  Marked non-deterministic only so that the optimizer does not
    copy the call into a pushed filter and run it twice.
    """
    @F.arrow_udf(return_type)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make()
        for batch in batches:
            for part in blocks(batch, block_bytes):
                yield fn(part)
            give_back()
    return run.asNondeterministic()


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later
    tasks, and what their allocators hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def batch_udf(return_type: str, make: Callable[[], Callable[..., pa.Array]], rows: int = 256):
    """A column function evaluated on slices of ``rows`` rows; ``make`` runs once
    per task."""
    @F.arrow_udf(return_type)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make()
        for batch in batches:
            for lo in range(0, max(len(batch), 1), rows):
                yield fn(batch.slice(lo, rows))
    return run.asNondeterministic()


def blocks(arr: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of at most ``block_bytes`` of text, one row at least.

    An empty array gives one empty slice.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if len(arr) == 0:
        yield arr
        return
    for lo, hi in block_ranges(arr, block_bytes):
        yield arr.slice(lo, hi - lo)


def block_ranges(arr: pa.Array, block_bytes: int = BLOCK_BYTES) -> list[tuple[int, int]]:
    """(from, to) row ranges of ``blocks``."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(arr), 0), dtype=np.int64))
    out, lo = [], 0
    while lo < len(arr):
        done = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + block_bytes, side="right")))
        out.append((lo, hi))
        lo = hi
    return out


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the document offsets in them; null is empty."""
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross documents.

    Returns starts, ends (exclusive) and, per document, the index of its first
    run (one entry more than documents).
    """
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    cuts = offs[:-1]
    before[cuts[cuts < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    cuts = offs[1:]
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64) over an unsigned array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class SpanHash:
    """Polynomial prefix hashes of a byte array: any span's hash in O(1)."""

    _P = 0x9E3779B97F4A7C15 | 1
    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._power) < n:
            size = -(-n >> 16 << 16)           # in steps of 65,536: the tables stay in the worker

            def table(base: int) -> np.ndarray:
                t = np.full(size, base, np.uint64)
                t[0] = 1
                return np.cumprod(t, dtype=np.uint64)
            cls._power = table(cls._P)
            cls._inverse = table(pow(cls._P, -1, 1 << 64))

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._grow(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        step = data.astype(np.uint64)
        step += np.uint64(1)
        step *= self._power[:n]
        np.cumsum(step, out=self.prefix[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = self.prefix[ends] - self.prefix[starts]
        x *= self._inverse[starts]
        x += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(x)


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes (document bounds not looked at)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = words[:n].copy()
    for j in range(1, k):
        acc *= np.uint64(0x9FB21C651E98DF25)
        acc += words[j:j + n]
    return mix(acc)


def window_ok(bounds: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """True where ``k`` words from here on lie in one document."""
    n = n_words - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    end = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(n) + k <= end[:n]


def cover(n: int, starts: np.ndarray, length) -> np.ndarray:
    """Boolean of positions inside any span [start, start + length)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:n]) > 0


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive bounds (empty documents: 0)."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Just the named input columns, renamed, so that extra columns of any name
    cannot clash with an operator's own."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def struct_array(schema: dict[str, pa.DataType], **columns) -> pa.Array:
    return pa.StructArray.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=schema[k]) for k, c in columns.items()],
        fields=[pa.field(k, schema[k]) for k in columns])


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage as a
    checkpoint does, in compressed columns."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark, path: str) -> None:
    """Delete a written table by Spark's own file system access."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def remainder(id_col, modulus: int) -> Column:
    """crc32(id as text) mod ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col) % modulus
