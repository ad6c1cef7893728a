"""Embedding whitening by spectrum slicing (12).

Statistics come from two passes in Spark tasks: counts and integer sums per
dimension, then the covariance of the centred vectors, each task adding its
rows up before anything is shuffled.  What reaches the driver is one number per
pair of dimensions, whatever the number of rows.  There the leading part of the
spectrum is sliced: an LDL^T factorisation of the covariance less a shift tells
by its inertia how many eigenvalues lie above the shift; bisection over shifts
isolates each leading eigenvalue, Rayleigh quotient iteration (cubic) gives its
vector, and two more counts just below and above certify its number.  A third
pass measures the covariance of the whitened rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.text import give_back, only, struct_array

SCALE, OFFSET = 64, 1_000_000     # fixed values of the contract: x = floor(64 c) + 1000000
COMPONENTS = 32
BLOCK_VALUES = 1 << 18            # vector entries that a task works on at once
RANK = 1e-13                      # eigenvalues up to dimensions x RANK x the largest count as zero
LARGEST = float(1 << 62)          # entries whose 64 c has no place in a long


# ------------------------------------------------------- symmetric matrices

def inertia(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric ``a`` above ``shift``: the positive pivots of
    LDL^T of a - shift I (symmetric pivoting, blocks of one or two rows)."""
    m = a - shift * np.eye(len(a))
    n, k, above = len(m), 0, 0
    tiny = np.finfo(float).eps * max(float(np.abs(m).max(initial=0.0)), np.finfo(float).tiny)
    bound = (1 + 17 ** 0.5) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j], k:] = m[[j, i], k:]
            m[k:, [i, j]] = m[k:, [j, i]]

    while k < n:
        column = np.abs(m[k + 1:, k])
        r = k + 1 + int(column.argmax()) if len(column) else k
        off = column[r - k - 1] if len(column) else 0.0
        two = False
        if abs(m[k, k]) < bound * off:
            row = np.abs(m[r, k:])
            row[r - k] = 0.0
            if abs(m[k, k]) * row.max() < bound * off * off:
                if abs(m[r, r]) >= bound * row.max():
                    swap(k, r)
                else:
                    two = True
                    swap(k + 1, r)
        if two:
            d, b = m[k:k + 2, k:k + 2].copy(), m[k + 2:, k:k + 2].copy()
            above += 1 if np.linalg.det(d) < 0 else 2 * int(d[0, 0] > 0)
            m[k + 2:, k + 2:] -= b @ np.linalg.solve(d, b.T)
            k += 2
        else:
            d = m[k, k]
            above += int(d > tiny)
            if abs(d) > tiny:
                b = m[k + 1:, k].copy()
                m[k + 1:, k + 1:] -= np.outer(b, b / d)
            k += 1
    return above


def _iterate(a: np.ndarray, shift: float, start: np.ndarray, known: np.ndarray, size: float):
    """Rayleigh quotient iteration from ``start`` after two steps at ``shift``,
    kept orthogonal to the rows of ``known``; (quotient, unit vector, residual)."""
    eye, v, rho, best, stuck = np.eye(len(a)), start, shift, None, 0
    for step in range(60):
        v = v - known.T @ (known @ v)
        norm = np.linalg.norm(v)
        if not norm > 0:
            v = np.cos(np.arange(1, len(a) + 1) * (step + 2.0))
            continue
        v = v / norm
        if step >= 2:
            rho = float(v @ a @ v)
            left = float(np.linalg.norm(a @ v - rho * v))
            stuck = 0 if best is None or left < best[0] / 2 else stuck + 1
            if best is None or left < best[0]:
                best = (left, rho, v)
            if left <= np.finfo(float).eps * size or stuck == 3:
                break
        at = rho
        while True:
            try:
                v = np.linalg.solve(a - at * eye, v)
                if np.isfinite(v).all():
                    break
            except np.linalg.LinAlgError:
                pass
            at += 4 * np.finfo(float).eps * size       # exactly on an eigenvalue: step beside it
        v = v / np.abs(v).max()
    v = best[2] - known.T @ (known @ best[2])
    v = v / np.linalg.norm(v)
    rho = float(v @ a @ v)
    return rho, v, float(np.linalg.norm(a @ v - rho * v))


class Spectrum(NamedTuple):
    values: np.ndarray        # falling
    vectors: np.ndarray       # one unit row per value
    certified: bool           # counts confirm every number


def leading(a: np.ndarray, k: int = COMPONENTS) -> Spectrum:
    """The leading ``k`` eigenpairs of a positive semidefinite matrix, fewer if
    fewer eigenvalues are above zero to double precision.

    Equal eigenvalues cannot be told apart: any orthonormal vectors of their
    space serve.  ``certified``: for each value, as many eigenvalues lie above its lower
    and upper bound as its number says (or the numbers of its cluster)."""
    a = (a + a.T) / 2
    n = len(a)
    size = float(np.abs(a).sum(axis=1).max(initial=0.0))       # Gershgorin: no eigenvalue above
    if n == 0 or not size > 0:
        return Spectrum(np.zeros(0), np.zeros((0, n)), True)
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia(a, shift)
        return counts[shift]

    top = size * (1 + 1e-12)
    counts[top] = 0
    low = n * RANK * size
    k = min(k, above(low))
    close = 64 * n * np.finfo(float).eps * size                # nearer values count as equal
    start = np.cos(np.arange(1, n + 1) ** 1.5)                 # fixed, with no structure of its own
    values, vectors, certified = [], np.zeros((0, n)), True
    while len(values) < k:
        i = len(values)
        # the tightest known slice that holds eigenvalue i + 1: counts i at its top, above i at its bottom
        hi = min(s for s, c in counts.items() if c <= i)
        lo = max(s for s, c in counts.items() if c > i)
        if above(lo) - above(hi) > 1 and hi - lo > close:
            above((lo + hi) / 2)
            continue
        m = min(above(lo), n) - i                              # 1, or a cluster of equal ones
        found = vectors
        got = []
        for j in range(m):
            rho, v, left = _iterate(a, (lo + hi) / 2, np.roll(start, j), found, size)
            got.append((rho, v, left))
            found = np.vstack([found, v])
        if hi - lo > close and not all(lo <= r <= hi and left <= close for r, _, left in got):
            above((lo + hi) / 2)                               # not there yet, or at a neighbour: cut the slice again
            continue
        got.sort(key=lambda x: -x[0])
        lower, upper = got[-1][0] - close, got[0][0] + close
        certified &= above(lower) >= i + m and above(upper) <= i
        values += [r for r, _, _ in got]
        vectors = np.vstack([vectors, *[v[None] for _, v, _ in got]])
    order = np.argsort(-np.array(values), kind="stable")[:k]
    return Spectrum(np.array(values)[order], vectors[order], certified)


# ------------------------------------------------------------ rows and tasks

def entries(c: Column) -> Column:
    """x = floor(64 c) + 1000000 of each entry, or null for a vector that drops out:
    null, or with a null, non-finite or too large entry."""
    c = c.cast("array<double>")
    ok = F.forall(c, lambda v: F.coalesce(F.abs(v * F.lit(float(SCALE))) < LARGEST, F.lit(False)))  # NaN is above all
    return F.when(ok, F.transform(c, lambda v: F.floor(v * F.lit(float(SCALE))) + F.lit(OFFSET)))


def _matrices(column: pa.Array, dim: int) -> Iterator[np.ndarray]:
    """Blocks of rows (int64) of a column of ``dim``-entry lists without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    step = max(1, BLOCK_VALUES // max(dim, 1))
    for lo in range(0, len(column), step):
        part = column.slice(lo, step)
        yield part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), dim)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: long where that cannot overflow, else Python integers."""
    most = max((abs(v) for v in sums), default=0) + n * int(np.abs(x).max(initial=0))
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(d: np.ndarray) -> list[int | None]:
    """Row sums of squares; null where the sum has no place in a long."""
    most = int(np.abs(d).max(initial=0))
    if most * most * max(d.shape[1], 1) < 1 << 63:
        d = d.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    total = (d.astype(object) ** 2).sum(axis=1)
    return [int(t) if t < 1 << 63 else None for t in total]


class Whitening(NamedTuple):
    """What ``fit`` learns: n, dimensions, exact sums, components, and the measured error."""
    n: int
    dim: int
    sums: list[int]
    trace: float
    spectrum: Spectrum
    identity_error: float

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n x - S, whitened rows)."""
        return _project(x, self.n, self.sums, self.spectrum)


def _project(x, n, sums, spectrum):
    d = centred(x, n, sums)
    y = d.astype(np.float64) / n
    return d, y @ (spectrum.vectors / np.sqrt(spectrum.values)[:, None]).T


def _products(vectors: DataFrame, width: int, make) -> np.ndarray:
    """Sum over all rows of y y^T and of y, for y = make()(block of x): each task adds
    up its rows, Spark adds the tasks' numbers per pair of dimensions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, fn = np.zeros((width, width + 1)), make()
        for batch in batches:
            for x in fn.blocks(batch.column(0)):
                y = fn(x)
                total[:, :width] += y.T @ y
                total[:, width] += y.sum(axis=0)
        give_back()
        i, j = np.triu_indices(width, 0, width + 1)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})
    out = np.zeros((width, width + 1))
    for i, j, v in (vectors.mapInArrow(run, "i int, j int, v double").groupBy("i", "j")
                    .agg(F.sum("v")).toLocalIterator()):
        out[i, j] = v
        if j < width:
            out[j, i] = v                  # the products are symmetric
    return out


class _Block:
    """A function of blocks that also cuts a column into them."""

    def __init__(self, dim: int, fn):
        self.dim, self.fn = dim, fn

    def blocks(self, column):
        return _matrices(column, self.dim)

    def __call__(self, x):
        return self.fn(x)


def remaining(df: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """(df with long list ``_x``, dimensions): rows whose vector drops out are gone;
    so are vectors of any but the most frequent length (of equally frequent ones the
    greatest): they lack entries."""
    d = df.withColumn("_x", entries(df[vector_col])).filter(F.col("_x").isNotNull())
    top = (d.groupBy(F.size("_x").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.desc("dim")).first())
    dim = top["dim"] if top else 0
    return d.filter(F.size("_x") == dim), dim


def fit(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Whitening of all remaining vectors.  Memory on the driver: dimensions squared."""
    rows, dim = remaining(only(df, vector=vector_col), "vector")
    return _fit(rows.select("_x"), dim, components)


def _fit(x: DataFrame, dim: int, components: int) -> Whitening:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal
        n, total = 0, [0] * dim
        for batch in batches:
            for block in _matrices(batch.column(0), dim):
                n += len(block)
                if len(block) * int(np.abs(block).max(initial=0)) >= 1 << 62:
                    block = block.astype(object)
                total = [a + int(b) for a, b in zip(total, block.sum(axis=0))]
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(-1, dim), pa.int32()),
            "v": pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))})
    got = {i: int(v) for i, v in x.mapInArrow(sums, "i int, v decimal(38,0)").groupBy("i")
           .agg(F.sum("v")).collect()}
    n, total = got.get(-1, 0), [got.get(i, 0) for i in range(dim)]
    if n == 0 or dim == 0:
        return Whitening(n, dim, total, 0.0, Spectrum(np.zeros(0), np.zeros((0, dim)), True), 0.0)
    def make():
        return _Block(dim, lambda b: centred(b, n, total).astype(np.float64) / n)
    v = _products(x, dim, make)[:, :dim] / n
    spectrum = leading(v, components)
    k = len(spectrum.values)
    if k == 0:
        return Whitening(n, dim, total, float(np.trace(v)), spectrum, 0.0)
    def white():
        return _Block(dim, lambda b: _project(b, n, total, spectrum)[1])
    w = _products(x, k, white)
    mean = w[:, k] / n
    error = np.abs(w[:, :k] / n - np.outer(mean, mean) - np.eye(k)).max()
    return Whitening(n, dim, total, float(np.trace(v)), spectrum, float(error))


def whiten(df: DataFrame, model: Whitening, vector_col: str = "embedding", out: str = "whitening") -> DataFrame:
    """``df`` with a struct column ``out`` (deviation, whitened); null where the vector
    drops out or has not the model's dimensions.  An existing column of that name is replaced."""
    fields = {"deviation": pa.int64(), "whitened": pa.list_(pa.float64())}

    @F.arrow_udf("deviation long, whitened array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        k = len(model.spectrum.values)
        for x in batches:
            keep = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
            dev, white = [None] * len(x), [None] * len(x)
            at = 0
            for block in _matrices(x.take(pa.array(keep)), model.dim):
                d, w = model.project(block) if k else (centred(block, model.n, model.sums), np.zeros((len(block), 0)))
                for r, s, y in zip(keep[at:at + len(block)], _squares(d), w):
                    dev[r], white[r] = s, y
                at += len(block)
            yield struct_array(fields, deviation=dev, whitened=white)
            give_back()
    x = entries(df[vector_col])
    x = F.when(F.size(x) == model.dim, x)
    found = run.asNondeterministic()(x)
    return df.withColumn(out, F.when(x.isNotNull(), found))


def report(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component.

    Null ids and repeated rows stay rows of their own and count in the fit.
    Components with an eigenvalue of zero (to double precision) cannot be
    whitened and have no rows; an empty table, or equal vectors only, gives none.
    ``deviation`` is null where it has no place in a long.
    """
    d = only(df, vec_id=id_col, vector=vector_col)
    rows, dim = remaining(d, "vector")
    model = _fit(rows.select("_x"), dim, components)
    values = model.spectrum.values
    explained = F.array(*[F.lit(float(e / model.trace)) for e in values]) if len(values) else \
        F.array().cast("array<double>")
    w = whiten(rows.drop("_x"), model, "vector", "w").filter(F.col("w").isNotNull())
    return (w.select("vec_id", F.col("w.deviation").alias("deviation"), F.posexplode("w.whitened"))
             .select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
                     "deviation", F.col("col").alias("whitened"),
                     F.get(explained, F.col("pos")).alias("explained"),
                     F.lit(model.identity_error).alias("identity_error")))
