"""Quality classifier (4): naive-Bayes support vectors.

N-gram indicators are scaled by class log-count ratios, taken over all labelled
rows, and a linear hinge-loss model is fitted on a bounded sample by dual
coordinate descent.  N-grams run over two token streams: the words (one and
two, lower-cased) and the words' shapes (one to three): classes of characters
that occur, first capital, length class, and whether the word repeats the one
before it.  They are hashed into ``SLOTS`` slots.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.labelled import platt, sigmoid, statistics, training_rows
from larder.llm.text import (HASHED_BYTES, LOWER, NON_SPACE, SpanHash, block_udf, give_back, mix, only, per_doc,
                             remainder, runs, utf8, window_hash, window_ok)

SLOTS = 1 << 18
PER_CLASS = 4000        # rows per class in the fitting sample
THRESHOLD = 0.3
MODULUS, HELD_OUT = 5, 0

_CLASS = np.zeros(256, np.uint8)          # one bit per kind of character
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[ord("A"):ord("Z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 4
_CLASS[0x80:] = 8
for _c in "#*$%&|<>":
    _CLASS[ord(_c)] = 16
for _c in "!?":
    _CLASS[ord(_c)] = 32
for _c in ".,;:'\"()-":
    _CLASS[ord(_c)] = 64
_CLASS[(_CLASS == 0) & NON_SPACE] = 128


def features(arr: pa.Array, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, slot) pairs of a block, ordered by document."""
    raw, offs = utf8(arr)
    s, e, bounds = runs(NON_SPACE[raw], offs)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(s)
    words = SpanHash(LOWER[raw]).spans(s, e)
    kinds = np.bitwise_or.reduceat(_CLASS[raw], s).astype(np.int64)
    first = _CLASS[raw[s]] == 2
    length = np.digitize(e - s, [2, 4, 8, 16])
    same = np.concatenate([[False], words[1:] == words[:-1]])
    same[bounds[:-1][bounds[:-1] < n]] = False
    shape = mix((kinds | first.astype(np.int64) << 8 | same.astype(np.int64) << 9 | length << 10).astype(np.uint64))
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keys = []
    for i, (stream, k) in enumerate(((words, 1), (words, 2), (shape, 1), (shape, 2), (shape, 3))):
        ok = np.flatnonzero(window_ok(bounds, n, k))
        h = window_hash(stream, k)[ok] + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        keys.append(doc[ok] * slots + (mix(h) >> np.uint64(1)).astype(np.int64) % slots)
    key = np.unique(np.concatenate(keys))
    return key // slots, key % slots


def _pack(arr: pa.Array) -> list[bytes]:
    doc, slot = features(arr)
    cut = np.searchsorted(doc, np.arange(len(arr) + 1))
    return [slot[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:])]


class Cases:
    """Rows of unit length (slots, values) over a packed sample, made where they are used."""

    def __init__(self, packed, ratio: np.ndarray, only=None):
        self.packed, self.ratio = packed, ratio
        self.only = range(len(packed)) if only is None else only

    def __len__(self) -> int:
        return len(self.only)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.frombuffer(self.packed[self.only[i]], "<i4")
        x = self.ratio[at].astype(np.float64)
        return at, x / max(float(np.sqrt(x @ x)), 1e-9)


def dual_coordinate_descent(rows, y: np.ndarray, c: np.ndarray,
                            slots: int, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """L1-loss linear support vector machine: max over 0 <= alpha_i <= c_i of the
    dual, one coordinate at a time in random order; w is kept up to date.
    ``rows``: (slots, values) of unit length; a constant 1 carries the bias."""
    w, bias = np.zeros(slots), 0.0
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            g = y[i] * (float(w[at] @ x) + bias) - 1.0
            new = min(max(alpha[i] - g / 2.0, 0.0), c[i])        # |x|^2 + 1 = 2
            d = (new - alpha[i]) * y[i]
            if d:
                w[at] += d * x
                bias += d
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w, bias


@dataclass
class Model:
    ratio: np.ndarray       # class log-count ratio per slot
    weight: np.ndarray      # ratio * hinge-loss weight per slot
    bias: float
    scale: np.ndarray       # calibration: slope and offset

    def scores(self, arr: pa.Array) -> np.ndarray:
        doc, slot = features(arr)
        bounds = np.searchsorted(doc, np.arange(len(arr) + 1))
        dot = per_doc(self.weight[slot].astype(np.float64), bounds)
        norm = np.sqrt(per_doc(self.ratio[slot].astype(np.float64) ** 2, bounds))
        margin = dot / np.maximum(norm, 1e-9) + self.bias
        return sigmoid(self.scale[0] * margin + self.scale[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Fit on the labelled rows that are not held out (crc32(id) mod 5 is not 0).

    Log-count ratios use all of them; the hinge-loss weights and the
    calibration use a sample bounded by ``per_class`` rows a class (rows with more than 16,384
    distinct slots are a stratum of their own, bounded by 8 MB of slots a class).  With
    labels of one class only, or none, every score is the share of label 1
    (0.5 without labels).
    """
    rows = training_rows(docs, labels, label, MODULUS, HELD_OUT, per_class, id_col, text_col)
    counts, n, ys, packed = statistics(rows, SLOTS, features, _pack)
    p, q = 1.0 + counts[1], 1.0 + counts[0]
    ratio = (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)
    y = np.array(ys, np.int64) * 2 - 1
    if len(set(ys)) < 2:
        share = (n[1] + 1) / (n.sum() + 2)
        return Model(ratio, np.zeros(SLOTS, np.float32), 0.0, np.array([0.0, np.log(share / (1 - share))]))
    order = np.random.default_rng(3).permutation(len(packed))
    test = np.zeros(len(packed), bool)
    test[order[: len(packed) // 4]] = True                     # calibration rows
    if min(len(set(y[test])), len(set(y[~test]))) < 2:
        test[:] = False
    use = np.flatnonzero(~test)
    w, bias = dual_coordinate_descent(Cases(packed, ratio, use), y[use], np.ones(len(use)), SLOTS)
    check = np.flatnonzero(test) if test.any() else use
    margin = np.array([float(w[at] @ x) + bias for at, x in (lambda c: (c[i] for i in range(len(c))))(Cases(packed, ratio, check))])
    share = np.array([n[int(v > 0)] / max(1, (y[check] == v).sum()) for v in y[check]])
    scale = platt(margin[:, None], (y[check] > 0).astype(float), share / share.mean())
    del packed
    give_back()                                # the sample, on the driver
    return Model(ratio, (w * ratio).astype(np.float32), bias, scale)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text (null: empty);
    an existing column ``out`` is replaced.  The model has a fixed size (3 MB)
    and is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))

    def make():
        m = Model(**held.value)
        return lambda arr: pa.array(m.scores(arr), pa.float64())
    return docs.withColumn(out, block_udf("double", make, HASHED_BYTES)(F.col(text_col)))


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.  A null id is not
    held out and never labelled; repeated rows stay."""
    model = fit(docs, labels, "quality", id_col, text_col)
    d = score(only(docs, doc_id=id_col, text=text_col), model)
    return d.select("doc_id", F.coalesce(remainder("doc_id", MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"),
                    "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those scored below ``threshold``; columns as they were."""
    tag = f"quality_{uuid.uuid4().hex}"        # a name that no column of the input has
    return score(docs, fit(docs, labels, "quality", id_col, text_col), text_col, tag).filter(
        F.col(tag) >= threshold).drop(tag)
