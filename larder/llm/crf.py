"""Toxicity (10): a linear-chain conditional random field with two tags.

Token labels come from the labelled documents: a token of a toxic document is
toxic if one of its features (word, prefixes, suffix) is tied to toxic documents
over all labelled rows.  The field has a weight per hashed feature and tag, and
one per pair of neighbouring tags; it is fitted by gradient steps on the
log-likelihood of a bounded sample.  How strongly a token's features are tied is
a feature of the token itself, so what all labelled rows say of a word counts
when texts are scored, whether or not the sample holds that word.
Forward-backward marginals give each token's probability; they aggregate to a
document score, and runs of probable tokens are the offending spans.

All documents of a block form one chain: the step into a document's first token
does not depend on the state before it, so the documents stay independent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.labelled import platt, sigmoid, statistics, training_rows
from larder.llm.text import (LOWER, WORD_CHARS, SpanHash, block_ranges, block_udf, mix, only, per_doc, remainder,
                             runs, struct_array, utf8)

SLOTS = 1 << 20
PER_CLASS = 1500        # rows per class in the fitting sample
LONG_BYTES = 1 << 20     # of which texts above 64 KB, per class (one text at least)
FIT_TEXT = 1 << 20      # bytes of the sample's texts in a block, whose gradients are added up
TIE_STEPS = 24          # levels of a tie's strength for one unit of log-odds
THRESHOLD = 0.5
MODULUS, HELD_OUT = 5, 0
_PREFIXES = (3, 4, 5, 6, 7, 8)      # bytes
_N = 2 + len(_PREFIXES)
CHUNK = 256             # tokens per lane of the forward and backward passes

RESULT = "score:double,spans:array<struct<start:int,stop:int,p:double>>"
_FIELDS = {"score": pa.float64(),
           "spans": pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))}


def tokens(arr: pa.Array):
    """Bytes, document offsets, token starts, ends, bounds and feature slots
    (one row per token: word, suffix, prefixes; a prefix that is no shorter than
    the word, or a suffix, falls back to the word)."""
    raw, offs = utf8(arr)
    data = LOWER[raw]
    s, e, bounds = runs(WORD_CHARS[data], offs)
    h = SpanHash(data)
    word = h.spans(s, e)
    size = e - s
    cols = [word, np.where(size > 4, h.spans(np.maximum(e - 4, s), e) + np.uint64(1), word)]
    for k in _PREFIXES:
        cols.append(np.where(size > k, h.spans(s, np.minimum(s + k, e)) + np.uint64(k), word))
    slots = np.empty((len(s), _N), np.int32)
    for i, c in enumerate(cols):
        slots[:, i] = (mix(c) % np.uint64(SLOTS)).astype(np.int32)
    return raw, offs, s, e, bounds, slots


def features(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, slot) pairs of a block."""
    _, _, _, _, bounds, slots = tokens(arr)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = np.unique((doc[:, None] * SLOTS + slots).ravel())
    return key // SLOTS, key % SLOTS


def _lanes(x: np.ndarray, fill: float) -> np.ndarray:
    """Cut a chain into lanes of CHUNK steps: [step, lane]."""
    lanes = max(1, -(-len(x) // CHUNK))
    pad = np.full(lanes * CHUNK - len(x), fill)
    return np.ascontiguousarray(np.concatenate([x, pad]).reshape(lanes, CHUNK).T)


def _sweep(step: list[np.ndarray], start: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised row vectors v_t = v_{t-1} @ step_t of one long chain; the steps are
    given by their four entries, row by row.

    Lanes of CHUNK steps first multiply out their own matrices, a short loop
    over lanes hands the vector on, then all lanes run from their start.
    """
    n = len(step[0])
    m00, m01, m10, m11 = (_lanes(x, fill) for x, fill in zip(step, (1.0, 0.0, 0.0, 1.0)))
    lanes = m00.shape[1]
    a, b, c, d = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for t in range(CHUNK):
        a, b = a * m00[t] + b * m10[t], a * m01[t] + b * m11[t]
        c, d = c * m00[t] + d * m10[t], c * m01[t] + d * m11[t]
        total = a + b + c + d
        a, b, c, d = a / total, b / total, c / total, d / total
    x, y = np.empty(lanes), np.empty(lanes)
    v, w = start
    for i in range(lanes):
        x[i], y[i] = v, w
        v, w = v * a[i] + w * c[i], v * b[i] + w * d[i]
        v, w = v / (v + w), w / (v + w)
    out = np.empty((2, CHUNK, lanes))
    for t in range(CHUNK):
        x, y = x * m00[t] + y * m10[t], x * m01[t] + y * m11[t]
        total = x + y
        x, y = x / total, y / total
        out[0, t], out[1, t] = x, y
    return out[0].T.reshape(-1)[:n], out[1].T.reshape(-1)[:n]


def marginals(unary: np.ndarray, pair: np.ndarray, bounds: np.ndarray,
              with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """P(tag 1) per token, and (if asked for) P(tag a at t-1, tag b at t) per token that
    is not a document's first.  ``unary``: score of tag 1 over tag 0; ``pair``: 2x2 scores."""
    n = len(unary)
    if n == 0:
        return np.zeros(0), np.zeros((0, 2, 2))
    u = np.clip(unary, -30, 30)
    node = np.exp(-np.maximum(u, 0)), np.exp(np.minimum(u, 0))
    move = np.exp(pair - pair.max())
    first = bounds[:-1][np.diff(bounds) > 0]
    final = bounds[1:][np.diff(bounds) > 0] - 1
    step = []
    for i in (0, 1):
        for j in (0, 1):
            x = move[i, j] * node[j]
            x[first] = node[j][first]                 # both rows equal: what came before is dropped
            step.append(x)
    fwd = _sweep(step, (0.5, 0.5))
    # backward: beta_t = step_{t+1} @ beta_{t+1}; a document's last token has beta 1
    back = []
    for k in (0, 2, 1, 3):
        x = np.empty(n)
        x[:-1] = step[k][1:]
        x[final] = 1.0
        back.append(x[::-1])
    beta = [x[::-1] for x in _sweep(back, (0.5, 0.5))]
    on, off = fwd[1] * beta[1], fwd[0] * beta[0]
    p = on / (off + on)
    if not with_pairs:
        return p, None
    opens = np.zeros(n, bool)
    opens[first] = True
    inner = np.flatnonzero(~opens)
    pairs = np.empty((len(inner), 2, 2))
    for k in range(4):
        pairs[:, k >> 1, k & 1] = fwd[k >> 1][inner - 1] * step[k][inner] * beta[k & 1][inner]
    pairs /= (pairs[:, 0, 0] + pairs[:, 0, 1] + pairs[:, 1, 0] + pairs[:, 1, 1])[:, None, None]
    return p, pairs


@dataclass
class Model:
    weight: np.ndarray      # per slot: score of the toxic tag
    bias: float
    pair: np.ndarray        # 2x2
    scale: np.ndarray       # document calibration
    tie: np.ndarray | None = None       # per slot: strength of its tie to toxic documents (0: none)
    tie_weight: np.ndarray | None = None    # for being tied, and for the strength

    def token_probs(self, slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        unary = self.weight[slots].sum(axis=1, dtype=np.float64) + self.bias
        if self.tie is not None:
            unary += tie_features(self.tie, slots) @ self.tie_weight
        return marginals(unary, self.pair, bounds, False)[0]

    def column(self, arr: pa.Array) -> pa.Array:
        raw, offs, s, e, bounds, slots = tokens(arr)
        p = self.token_probs(slots, bounds)
        score = sigmoid(aggregate(p, bounds) @ self.scale[:-1] + self.scale[-1])
        hit = np.flatnonzero(p >= 0.5)
        point = np.cumsum((raw & 0xC0) != 0x80)              # code points up to and with a byte
        doc = np.searchsorted(bounds, hit, side="right") - 1
        before = np.where(offs[doc] > 0, point[offs[doc] - 1], 0) if len(hit) else np.zeros(0, np.int64)
        spans = pa.StructArray.from_arrays(
            [pa.array(point[s[hit]] - 1 - before, pa.int32()), pa.array(point[e[hit] - 1] - before, pa.int32()),
             pa.array(p[hit])], names=["start", "stop", "p"])
        cut = np.searchsorted(hit, bounds)
        return struct_array(_FIELDS, score=score,
                            spans=pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spans))


def aggregate(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document: log-odds of the most probable token, and the log of the
    expected number of tokens that are at all likely (p > 0.2)."""
    top = np.zeros(len(bounds) - 1)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    np.maximum.at(top, doc, p)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.column_stack([np.log(top / (1 - top)), np.log1p(per_doc(np.where(p > 0.2, p, 0.0), bounds))])


def tied_slots(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Feature slots tied to toxic documents: at least half of their documents
    are toxic, and the toxic ones are 4.5 standard deviations above chance."""
    neg, pos = counts
    rate = (docs[1] + 1) / (docs.sum() + 2)
    chance = (pos + neg) * rate
    return (pos >= 3) & (pos >= neg) & (pos - chance >= 4.5 * np.sqrt(chance + 0.25))


def tie_levels(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Per slot, 0 if it is not tied to toxic documents, else 1 to 255 by how far the
    log-odds of its documents exceed those of all documents."""
    neg, pos = counts
    far = np.log((pos + 0.5) / (neg + 0.5)) - np.log((docs[1] + 0.5) / (docs[0] + 0.5))
    return np.where(tied_slots(counts, docs), np.clip(far * TIE_STEPS, 1, 255), 0).astype(np.uint8)


def tie_features(tie: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Per token: whether one of its slots is tied, and the strongest tie (0 to 1)."""
    level = tie[slots].max(axis=1, initial=0)
    return np.column_stack([level > 0, level / 255])


class _Adam:
    def __init__(self, size: int):
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0

    def move(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.99 * self.v + 0.01 * g * g
        return 0.3 * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.99 ** self.t)) + 1e-6)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", per_class: int = PER_CLASS, steps: int = 40) -> Model:
    """Fit on labelled rows that are not held out (crc32(id) mod 5 is not 0): the
    ties of features to toxic documents over all of them, the field's weights on
    a sample bounded by ``per_class`` rows a class (texts above 64 KB are a stratum of their
    own, bounded by LONG_BYTES a class).  Labels of
    one class only, or none, give the share of label 1 as every score.

    Bias, tag pairs and the weights of the ties are fitted first and then kept, so a
    token whose slots the sample lacks is judged by its ties alone; slots in the
    sample get weights on top.  The sample goes through block by block, and the
    blocks' gradients are added up.
    """
    rows = training_rows(docs, labels, label, MODULUS, HELD_OUT, per_class, id_col, text_col)
    counts, n, ys, texts = statistics(rows, SLOTS, features, lambda a: [t.encode() for t in a.to_pylist()],
                                       LONG_BYTES)
    y = np.array(ys, np.int64)
    if len(set(ys)) < 2:
        share = (n[1] + 1) / (n.sum() + 2)
        return Model(np.zeros(SLOTS, np.float32), 0.0, np.zeros((2, 2)),
                     np.array([0.0, 0.0, np.log(share / (1 - share))]))
    tie = tie_levels(counts, n)
    arr = pa.array([bytes(texts[i]).decode() for i in range(len(texts))], pa.large_string())
    del texts
    parts, used = [], np.zeros(SLOTS, bool)
    for lo, hi in block_ranges(arr, FIT_TEXT):
        _, _, _, _, bounds, slots = tokens(arr.slice(lo, hi - lo))
        toxic = np.repeat(y[lo:hi] == 1, np.diff(bounds))
        ties = tie_features(tie, slots)
        tag = ((ties[:, 0] > 0) & toxic).astype(np.float64)
        opens = np.zeros(len(tag), bool)
        opens[bounds[:-1][np.diff(bounds) > 0]] = True
        inner = np.flatnonzero(~opens)
        seen = np.zeros((2, 2))
        np.add.at(seen, (tag[inner - 1].astype(int), tag[inner].astype(int)), 1.0)
        used[slots.ravel()] = True
        parts.append((bounds, slots, ties, tag, seen))
    used = np.flatnonzero(used)
    place = np.zeros(SLOTS, np.int32)
    place[used] = np.arange(len(used))
    parts = [(bounds, np.ascontiguousarray(place[slots].T), *rest) for bounds, slots, *rest in parts]
    scale = max(1.0, sum(tag.sum() for *_, tag, _ in parts))
    # Adam on the log-likelihood: bias, pairs and ties
    few = np.concatenate([[-3.0], np.zeros(6)])
    adam = _Adam(len(few))
    for _ in range(steps):
        g = 1e-5 * few
        for bounds, _, ties, tag, seen in parts:
            p, pairs = marginals(ties @ few[5:] + few[0], few[1:5].reshape(2, 2), bounds)
            diff = (p - tag) / scale
            g += np.concatenate([[diff.sum()], ((pairs.sum(axis=0) - seen) / scale).ravel(), ties.T @ diff])
        few -= adam.move(g)
    bias, pair, tie_weight = float(few[0]), few[1:5].reshape(2, 2), few[5:]
    # then the slots, with a small ridge
    w, adam = np.zeros(len(used)), _Adam(len(used))
    for _ in range(steps):
        g = 1e-5 * w
        for bounds, slots, ties, tag, _ in parts:
            unary = ties @ tie_weight + bias
            for k in range(_N):
                unary += w[slots[k]]
            diff = (marginals(unary, pair, bounds, False)[0] - tag) / scale
            for k in range(_N):
                g += np.bincount(slots[k], weights=diff, minlength=len(used))
        w -= adam.move(g)
    weight = np.zeros(SLOTS, np.float32)
    weight[used] = w
    model = Model(weight, bias, pair, np.zeros(3), tie, tie_weight)
    x = np.concatenate([aggregate(model.token_probs(used[slots.T], bounds), bounds) for bounds, slots, *_ in parts])
    share = np.array([n[v] / max(1, (y == v).sum()) for v in y])
    model.scale = platt(x, y.astype(float), share / share.mean(), ridge=0.05)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``out``: document score and offending spans
    (code points, with the token's probability).  Null and empty texts have no
    token and get the score of a text without toxic tokens.  The model has a
    fixed size (5 MB) and is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))

    def make():
        m = Model(**held.value)
        return m.column
    return docs.withColumn(out, block_udf(f"struct<{RESULT}>", make)(F.col(text_col)))


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans.  A null id
    is not held out and never labelled; repeated rows stay."""
    model = fit(docs, labels, "toxic", id_col, text_col)
    d = score(only(docs, doc_id=id_col, text=text_col), model)
    return d.select("doc_id", F.coalesce(remainder("doc_id", MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"),
                    "toxicity.score", (F.col("toxicity.score") >= THRESHOLD).cast("int").alias("predicted"),
                    F.to_json("toxicity.spans").alias("spans"))
