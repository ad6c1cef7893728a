"""LM scoring (5): online logistic context mixing.

A text is its lower-cased words, each followed by a space, then an end symbol, as
bytes.  Every bit of every byte is predicted by several models, one per context:
the last 1 to ORDERS bytes and the word so far, hashed with the bits already
known of this byte.  For a word's first byte the contexts are the last bytes of
the word before.  Each model looks up how often the bit was 0 and 1 in its
context over the whole learning corpus.  Their stretched probabilities are
combined by weights that a gate selects, learned online by gradient steps on
coding cost, and the result is refined by an adaptive probability map; every word and
first byte of the learning corpus takes part.  The sum
of the bits' costs is the text's coding length (bits per byte).

Contexts inside a word depend on the word only, so each distinct word of the
corpus is scored once, in Spark, and its cost comes back to the texts with its
count; a word's first byte is scored with the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.text import (HASHED_BYTES, LOWER, NON_SPACE, SpanHash, block_ranges, give_back, mix, only, per_doc,
                             remainder, runs, stored, utf8)

ORDERS = 5
MODELS = ORDERS + 1       # byte contexts and the word so far
SIZES = [1 << 17, 1 << 18, 1 << 19, 1 << 19, 1 << 20, 1 << 21]     # hashed slots per model
STARTS = [sum(SIZES[:i]) for i in range(MODELS)]
SLOTS = sum(SIZES)
BACK = 4                  # bytes of the word before that a first byte's contexts see
END = 0x00                # end symbol; also what stands before a text
MODULUS, HELD_OUT = 10, 0
PASS_WORDS = 200_000      # words that all passes of learning take together at least (4 passes at most)
TASK_WORDS = 50_000       # words that a task learns from at least: a mean of very many short walks goes less far
BUCKET_BYTES = 12 << 20   # text per bucket of the word lookup
MAP_BINS = 33
GATES = [1, 2, 4, 16, 64, 400]          # cases seen in a context, as classes for the gate
_GATE_AT = np.minimum(1.0, np.log1p(np.array(GATES)) / np.log1p(GATES[-1])) - 1e-3
_SIDE = len(GATES) + 1                  # classes of one confidence; a depth has _SIDE ** 2 weight sets
_CONFIDENCE = np.minimum(1.0, np.log1p(np.arange(GATES[-1] + 1)) / np.log1p(GATES[-1]))     # by cases seen
_CLASS = np.searchsorted(_GATE_AT, _CONFIDENCE, side="right")
_CLASS16 = np.searchsorted(_GATE_AT, np.arange(0x3C01, dtype=np.uint16).view(np.float16).astype(np.float32),
                           side="right")        # by the bits of a confidence (0 to 1) kept in 16 bits
_STRETCH = 8.0
_SEED = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.arange(MODELS + 1, dtype=np.uint64) * _SEED


class Words:
    """The words of a block of texts, lower-cased.  0x00 is the end symbol, so a text's own
    0x00 and 0x01 become two bytes each: 0x01 0x02 and 0x01 0x01."""

    def __init__(self, arr: pa.Array):
        raw, offs = utf8(arr)
        low = raw <= 1
        if low.any():
            at = np.concatenate([[0], np.cumsum(1 + low)])
            second = np.where(raw[low] == 0, 2, 1)
            raw = np.repeat(np.where(low, 1, raw).astype(np.uint8), 1 + low)
            raw[at[1:][low] - 1] = second
            offs = at[offs]
        self.data = LOWER[raw]
        self.s, self.e, self.bounds = runs(NON_SPACE[raw], offs)
        self.hash = SpanHash(self.data).spans(self.s, self.e).view(np.int64)
        self.n = np.diff(self.bounds)

    def first_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Key of the first byte after every boundary (each word's first byte, then
        END, per text): that byte and the last BACK bytes of the word before.
        Also the bounds per text."""
        n, d = len(self.s), len(self.n)
        doc = np.repeat(np.arange(d), self.n)
        at = np.arange(n) + doc                         # one END per text before
        bounds = self.bounds + np.arange(d + 1)
        byte = np.zeros(n + d, np.int64)
        byte[at] = self.data[self.s]
        before = np.full(n + d, -1)
        before[at + 1] = np.arange(n)                   # the word before the next boundary
        before[bounds[:-1]] = -1
        key = byte
        i = np.flatnonzero(before >= 0)
        w = before[i]
        for j in range(BACK):
            p = self.e[w] - 1 - j
            ok = p >= self.s[w]
            key[i[ok]] |= self.data[p[ok]].astype(np.int64) << (8 * (j + 1))
        return key, bounds


def first_contexts(key: np.ndarray) -> list[np.ndarray]:
    """Per model, the context of a first byte: the last 1..BACK bytes before the
    boundary, then none."""
    out = []
    for k in range(1, MODELS + 1):
        ctx = (key >> 8) & ((1 << 8 * k) - 1) if k <= BACK else np.zeros_like(key)
        out.append(mix((ctx.astype(np.uint64) << np.uint64(8)) + np.uint64(k) + _SEED))
    return out


def inner_cases(arr: pa.Array):
    """Cases inside the words of a string array (one word per entry, no spaces):
    every byte but the first, and the space after the word.  Returns the byte,
    the contexts per model, and the word of each case."""
    data, offs = utf8(arr)
    size = np.diff(offs)
    word = np.repeat(np.arange(len(size)), size)        # a case per byte: the one that follows it
    at = np.arange(len(data))
    nxt = np.full(len(data), 0x20, np.int64)
    nxt[:-1] = data[1:]
    nxt[offs[1:][size > 0] - 1] = 0x20
    start = offs[:-1][word]
    h = SpanHash(data)
    contexts = [h.spans(np.maximum(at + 1 - k, start), at + 1) + _SALTS[k] for k in range(1, ORDERS + 1)]
    contexts.append(h.spans(start, at + 1))
    return nxt, contexts, word


def slots_of(contexts: list[np.ndarray], node: np.ndarray) -> np.ndarray:
    """Slot per model for a bit's node (1, then the known bits): [model, case]."""
    step = node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out = np.empty((len(contexts), len(node)), np.int64)
    for m, c in enumerate(contexts):
        x = (c + step) * np.uint64(0xBF58476D1CE4E5B9)
        out[m] = (x >> np.uint64(65 - SIZES[m].bit_length())).astype(np.int64) + STARTS[m]
    return out


def bits_of(byte: np.ndarray, contexts: list[np.ndarray]):
    """Per bit of the cases' bytes: depth, node, the bit, slots."""
    for bit in range(7, -1, -1):
        node = (1 << (7 - bit)) | (byte >> (bit + 1))
        yield 7 - bit, node, (byte >> bit) & 1, slots_of(contexts, node)


def distinct_cases(arr: pa.Array):
    """The distinct cases inside the words of a string array (equal beginnings share
    theirs): byte, contexts, and per case of ``inner_cases`` its distinct one and its word."""
    byte, contexts, word = inner_cases(arr)
    _, first, at = np.unique(mix(contexts[-1] + byte.astype(np.uint64) * _SEED),
                             return_index=True, return_inverse=True)
    return byte[first], [c[first] for c in contexts], at, word


def add_counts(total: np.ndarray, byte: np.ndarray, contexts: list[np.ndarray], n: np.ndarray) -> None:
    """Add ``n`` to ``total[slot, bit]`` for every bit of every case."""
    flat, n = total.reshape(-1), n.astype(total.dtype)
    for _, _, b, slots in bits_of(byte, contexts):
        slots *= 2
        slots += b
        for row in slots:
            np.add.at(flat, row, n)


@dataclass
class Model:
    """``table``: per slot the stretched probability of a 1 and the confidence in it
    (0 where nothing was seen, 1 from GATES[-1] cases on); ``weight``: [gate,
    inputs]; ``refine``: adaptive probability map by known bits and stretched probability."""

    table: np.ndarray
    weight: np.ndarray
    refine: np.ndarray

    @staticmethod
    def stretched(counts: np.ndarray) -> np.ndarray:
        zero, one = counts[..., 0], counts[..., 1]
        p = np.clip(np.log((one + 0.05) / (zero + 0.05)), -_STRETCH, _STRETCH)
        return np.stack([p, np.minimum(1.0, np.log1p(zero + one) / np.log1p(GATES[-1]))], axis=-1)

    @staticmethod
    def mixed(p: np.ndarray, sure: np.ndarray, weight: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Mixed stretched probability of p[model, case] with confidences ``sure``; ``weight``: a depth's
        weight sets as [inputs, set], of which ``gate`` chose one a case, by the confidence of the word so
        far and of the longest byte context."""
        st = weight[-1].take(gate)
        for m in range(len(p)):
            st += p[m] * (weight[2 * m].take(gate) + sure[m] * weight[2 * m + 1].take(gate))
        return np.clip(st, -_STRETCH, _STRETCH)

    @staticmethod
    def sets(weight: np.ndarray, depth: int) -> np.ndarray:
        """The weight sets of a depth, as a view."""
        return weight[depth * _SIDE ** 2:(depth + 1) * _SIDE ** 2]

    @staticmethod
    def bins(st: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (st + _STRETCH) * ((MAP_BINS - 1) / (2 * _STRETCH))
        lo = np.minimum(x.astype(np.int64), MAP_BINS - 2)
        return lo, x - lo

    def cost(self, byte: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each case's byte."""
        out = np.zeros(len(byte))
        pairs, refine = self.table.view(np.uint32).reshape(-1), self.refine.reshape(-1)
        weights = [np.ascontiguousarray(self.sets(self.weight, depth).T) for depth in range(8)]
        for lo in range(0, len(byte), 1 << 12):
            part = slice(lo, lo + (1 << 12))
            p = np.ones(len(byte[part]))
            for depth, node, bit, slots in bits_of(byte[part], [c[part] for c in contexts]):
                x = pairs.take(slots).view(np.uint16).reshape(*slots.shape, 2)     # a slot's pair is fetched at once
                gate = _CLASS16.take(x[-1, :, 1]) * _SIDE + _CLASS16.take(x[-2, :, 1])
                x = x.view(np.float16)
                st = self.mixed(x[..., 0].astype(np.float32), x[..., 1].astype(np.float32), weights[depth], gate)
                b, frac = self.bins(st)
                b += node * MAP_BINS
                one = 0.5 / (1 + np.exp(-st)) + 0.5 * (refine.take(b) * (1 - frac) + refine.take(b + 1) * frac)
                one = np.clip(one, 1e-5, 1 - 1e-5)
                p *= np.where(bit == 1, one, 1 - one)
            out[part] = np.log10(p)
        return out

    def word_costs(self, arr: pa.Array) -> np.ndarray:
        """log10 probability of what follows each word's first byte; equal beginnings
        are scored once per block."""
        out = []
        for lo, hi in block_ranges(arr, 1 << 18):
            byte, contexts, at, word = distinct_cases(arr.slice(lo, hi - lo))
            out.append(np.bincount(word, weights=self.cost(byte, contexts)[at], minlength=hi - lo))
        return np.concatenate(out) if out else np.zeros(0)


@dataclass
class Mixer:
    """What is learned online: mixing weights, the squared steps of each so far, and the map; ``seen`` counts the
    steps of each entry of the map in the last pass."""

    weight: np.ndarray
    speed: np.ndarray
    refine: np.ndarray
    seen: np.ndarray

    @staticmethod
    def new() -> Mixer:
        weight = np.full((8 * (len(GATES) + 1) ** 2, 2 * MODELS + 1), 0.08)
        weight[:, -3:-1] = 0.25
        weight[:, -1] = 0.0
        spread = np.linspace(-_STRETCH, _STRETCH, MAP_BINS)
        refine = np.clip(np.tile(1 / (1 + np.exp(-spread)), (256, 1)), 0.0005, 0.9995)
        return Mixer(weight, np.full(weight.shape, 1.0), refine, np.zeros(refine.shape))

    def copy(self) -> Mixer:
        return Mixer(self.weight.copy(), self.speed.copy(), self.refine.copy(), np.zeros(self.seen.shape))

    def learn(self, counts: np.ndarray, byte: np.ndarray, contexts: list[np.ndarray], n: np.ndarray,
              batch: int, rate: float = 0.05) -> None:
        """Online pass over cases in the given order.  Each case's own bit is taken out
        of its contexts once, so a context is not trusted for what only it has shown;
        the map follows the mixed probability with its own small steps."""
        pairs = np.ascontiguousarray(counts, np.float32).view(np.complex64).reshape(-1)
        refine, seen = self.refine.reshape(-1), self.seen.reshape(-1)
        for lo in range(0, len(byte), batch):
            part = slice(lo, lo + batch)
            m = n[part].astype(np.float64)
            for depth, node, bit, slots in bits_of(byte[part], [c[part] for c in contexts]):
                c = pairs.take(slots)                      # a slot's two counts are fetched at once
                zero = np.maximum(c.real.astype(np.float64) - (1 - bit), 0.0)
                one = np.maximum(c.imag.astype(np.float64) - bit, 0.0)
                cases = np.minimum(zero + one, GATES[-1]).astype(np.int64)
                p = np.clip(np.log((one + 0.05) / (zero + 0.05)), -_STRETCH, _STRETCH)
                sure = _CONFIDENCE.take(cases)
                gate = _CLASS.take(cases[-1]) * _SIDE + _CLASS.take(cases[-2])
                weight, speed = Model.sets(self.weight, depth), Model.sets(self.speed, depth)
                st = Model.mixed(p, sure, np.ascontiguousarray(weight.T), gate)
                err = (bit - 1 / (1 + np.exp(-st))) * m
                sure *= p
                g = np.empty_like(weight)
                for k, x in enumerate([*np.stack([p, sure], axis=1).reshape(-1, len(err)), 1.0]):
                    g[:, k] = np.bincount(gate, weights=x * err, minlength=len(g))
                speed += g * g
                weight += rate * g / np.sqrt(speed)
                b, frac = Model.bins(st)
                at = node * MAP_BINS + np.where(frac > 0.5, b + 1, b)
                np.add.at(refine, at, 0.02 * (bit - refine.take(at)))
                own = slice(MAP_BINS << depth, MAP_BINS << depth + 1)       # of the nodes at this depth
                seen[own] += np.bincount(at - own.start, minlength=own.stop - own.start)
                np.clip(refine[own], 0.0005, 0.9995, out=refine[own])

    def moves(self, start: Mixer) -> tuple[np.ndarray, np.ndarray]:
        """Per entry (weights, then the map): how far it moved since ``start`` times how much it
        was used, and that use."""
        use = np.concatenate([(self.speed - start.speed).ravel(), self.seen.ravel()])
        far = np.concatenate([(self.weight - start.weight).ravel(), (self.refine - start.refine).ravel()])
        return far * use, use

    def moved(self, far: np.ndarray, use: np.ndarray, tasks: int) -> Mixer:
        """After the moves of ``tasks`` tasks, added up: every entry moves by their mean, by use."""
        step = far / np.maximum(use, 1e-300)
        k = self.weight.size
        return Mixer(self.weight + step[:k].reshape(self.weight.shape),
                     self.speed + use[:k].reshape(self.speed.shape) / max(1, tasks),
                     self.refine + step[k:].reshape(self.refine.shape), use[k:].reshape(self.seen.shape))

    def model(self, counts: np.ndarray) -> Model:
        return Model(Model.stretched(counts).astype(np.float16), self.weight.astype(np.float32),
                     self.refine.astype(np.float32))


def learn(counts: np.ndarray, byte: np.ndarray, contexts: list[np.ndarray], n: np.ndarray,
          batch: int = 128, passes: int = 2) -> Model:
    """The model learned from the given cases in one process."""
    mixer = Mixer.new()
    for _ in range(passes):
        mixer.learn(counts, byte, contexts, n, batch)
    return mixer.model(counts)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def corpus_words(docs: DataFrame) -> DataFrame:
    """Of ``docs(text, bucket, learn)``: rows (bucket, word, n, word_text) with the distinct words
    of each bucket's texts (64-bit hashes) and their number in learning texts,
    and rows (null, key, n, null) with the first-byte keys of learning texts.  Each
    task adds up what it has before the shuffle."""
    def words_added(parts: list[tuple]) -> tuple:
        w, first, at = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        return w, n, pa.concat_arrays([p[2] for p in parts]).take(pa.array(first))

    def rows(bucket, w: np.ndarray, n: np.ndarray, text) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(w), 1 << 18):
            part = slice(lo, lo + (1 << 18))
            m = len(w[part])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int32()) if bucket is None else pa.array(np.full(m, bucket, np.int32)),
                 pa.array(w[part]), pa.array(n[part]),
                 pa.nulls(m, pa.string()) if text is None else text[part].cast(pa.string())],
                names=["bucket", "word", "n", "word_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        keys: list = []
        for b in batches:
            text, bucket = b.column(0).cast(pa.large_string()), b.column(1).to_numpy()
            learned = b.column(2).to_numpy(zero_copy_only=False)
            for lo, hi in block_ranges(text):
                block = Words(text.slice(lo, hi - lo))
                doc = np.repeat(np.arange(lo, hi), block.n)
                flat = block.data.tobytes()
                key, bounds = block.first_keys()
                key = key[np.repeat(learned[lo:hi], np.diff(bounds))]
                keys.append(np.unique(key, return_counts=True))
                if len(keys) > 8:
                    keys = [_added(keys)]
                for k in np.unique(bucket[lo:hi]).tolist():
                    mine = np.flatnonzero(bucket[doc] == k)
                    w, first, at = np.unique(block.hash[mine], return_index=True, return_inverse=True)
                    n = np.bincount(at, weights=learned[doc[mine]].astype(float), minlength=len(w)).astype(np.int64)
                    first = mine[first]
                    words = pa.array([flat[x:y].decode() for x, y in
                                      zip(block.s[first].tolist(), block.e[first].tolist())], pa.large_string())
                    held = total.setdefault(k, [])
                    held.append((w, n, words))
                    if len(held) > 8:
                        total[k] = [words_added(held)]
            give_back()
        for k, held in total.items():
            w, n, words = words_added(held)
            yield from rows(k, w, n, words)
        if keys:
            yield from rows(None, *_added(keys), None)
    return docs.select("text", "bucket", "learn").mapInArrow(
        run, "bucket int, word long, n long, word_text string")


def _tasks(df: DataFrame) -> int:
    return max(6, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)


def context_counts(vocabulary: DataFrame, firsts: DataFrame) -> np.ndarray:
    """[SLOTS, 2]: how often a 0 and a 1 followed each hashed context, from the corpus
    counts of words(word_text, c) and first-byte keys(word, c)."""
    def slot_rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(total.any(axis=1))
        for lo in range(0, len(at), 1 << 18):
            part = at[lo:lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part, 0]),
                                              pa.array(total[part, 1])], names=["slot", "zero", "one"])

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SLOTS, 2))
        for b in batches:
            text, n = b.column(0).cast(pa.large_string()), b.column(1).to_numpy()
            for lo, hi in block_ranges(text, 1 << 18):
                byte, contexts, at, word = distinct_cases(text.slice(lo, hi - lo))
                add_counts(total, byte, contexts, np.bincount(at, weights=n[lo:hi][word], minlength=len(byte)))
            give_back()
        yield from slot_rows(total)

    def of_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SLOTS, 2))
        for b in batches:
            key, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            add_counts(total, key & 0xFF, first_contexts(key), n)
        yield from slot_rows(total)
    tasks = _tasks(vocabulary)
    kind = "slot int, zero double, one double"
    rows = vocabulary.coalesce(tasks).mapInArrow(of_words, kind).union(firsts.coalesce(tasks).mapInArrow(of_firsts, kind))
    table = rows.groupBy("slot").agg(F.sum("zero").alias("zero"),
                                     F.sum("one").alias("one")).toArrow()
    counts = np.zeros((SLOTS, 2), np.float32)
    at = table.column("slot").to_numpy()
    counts[at, 0], counts[at, 1] = table.column("zero").to_numpy(), table.column("one").to_numpy()
    return counts


def mixed_pass(vocabulary: DataFrame, firsts: DataFrame, start: Mixer, counts, batch: int, tasks: int) -> Mixer:
    """``start`` after one pass over all words and first-byte keys: every task learns from its own, and their
    moves are added up by entry.  ``counts``: broadcast context counts."""
    held = vocabulary.sparkSession.sparkContext.broadcast(start)

    def entries(mine: Mixer) -> pa.RecordBatch:
        far, use = mine.moves(held.value)
        at = np.flatnonzero(use)
        return pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(far[at], 0.0)),
                                           pa.array(np.append(use[at], 1.0))], names=["entry", "far", "used"])

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = held.value.copy()
        for b in batches:
            text, n = b.column(0).cast(pa.large_string()), b.column(1).to_numpy()
            for lo, hi in block_ranges(text, 1 << 18):
                byte, contexts, at, word = distinct_cases(text.slice(lo, hi - lo))
                many = np.bincount(at, weights=n[lo:hi][word], minlength=len(byte))
                order = np.random.default_rng(5).permutation(len(byte))
                mine.learn(counts.value, byte[order], [c[order] for c in contexts], many[order], batch)
            give_back()
        yield entries(mine)

    def of_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = held.value.copy()
        for b in batches:
            key, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.random.default_rng(5).permutation(len(key))
            key = key[order]
            mine.learn(counts.value, key & 0xFF, first_contexts(key), n[order], batch)
        yield entries(mine)
    kind = "entry long, far double, used double"
    rows = vocabulary.coalesce(tasks).mapInArrow(of_words, kind).union(firsts.coalesce(tasks).mapInArrow(of_firsts, kind))
    got = rows.groupBy("entry").agg(F.sum("far").alias("far"), F.sum("used").alias("used")).toArrow()
    at = got.column("entry").to_numpy()
    far, use = np.zeros((2, start.weight.size + start.refine.size))
    ok = at >= 0
    far[at[ok]], use[at[ok]] = got.column("far").to_numpy()[ok], got.column("used").to_numpy()[ok]
    return start.moved(far, use, int(got.column("used").to_numpy()[~ok].sum()))


def fit(vocabulary: DataFrame, firsts: DataFrame) -> Model:
    """The model of a corpus given by its word counts and first-byte keys, all of which go into
    the context counts (a table of SLOTS slots at most), the mixing weights and the map.  A small
    corpus is gone through more than once (PASS_WORDS)."""
    spark = vocabulary.sparkSession
    counts = context_counts(vocabulary, firsts)
    words = vocabulary.count()
    held = spark.sparkContext.broadcast(counts)
    mixer = Mixer.new()
    tasks = max(1, min(_tasks(vocabulary), words // TASK_WORDS))
    for _ in range(min(4, -(-PASS_WORDS // max(1, words)))):
        mixer = mixed_pass(vocabulary, firsts, mixer, held, int(np.clip(words // 500, 128, 2048)), tasks)
    held.unpersist()
    return mixer.model(counts)


RESULT = ("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double, bits_per_byte double")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base
    score, score (log10 probability of the mixing model) and bits per byte.

    Texts are dealt to buckets of about BUCKET_BYTES by a hash of id and text;
    a bucket's distinct words meet the corpus counts and word costs by a join on the word
    and come back to the bucket, so no vocabulary is ever held whole.  Null texts
    are empty; a null id is not held out; repeated rows stay.  Words are told
    apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    d = only(docs, doc_id=id_col, text=F.coalesce(F.col(text_col), F.lit("")))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BUCKET_BYTES))
    d = d.withColumn("learn", F.coalesce(remainder("doc_id", MODULUS) != HELD_OUT, F.lit(True))).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    found = stored(corpus_words(d.repartition(max(n, 6), "bucket")), "words", "zstd")
    words = found.filter("bucket is not null")
    counts = stored(words.groupBy("word").agg(F.sum("n").alias("c"), F.min("word_text").alias("word_text")), "counts", "zstd")
    firsts = stored(found.filter("bucket is null").groupBy("word").agg(F.sum("n").alias("c")), "firsts", "zstd")
    ends = firsts.filter(F.col("word").bitwiseAND(F.lit(0xFF)) == END).agg(F.sum("c")).first()[0] or 0
    kinds = counts.filter("c > 0").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    train_tokens = (kinds.n or 0) + ends
    distinct = kinds.v + (1 if ends else 0)
    model = fit(counts.filter("c > 0").select("word_text", "c"), firsts)
    held = spark.sparkContext.broadcast(vars(model))

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(m.word_costs(b.column(2).cast(pa.large_string())))],
                names=["word", "c", "cost"])
            give_back()
    costed = counts.mapInArrow(costs, "word long, c long, cost double")
    known = words.select("bucket", "word").join(costed, "word").select("bucket", "word", "c", "cost")

    def scored(texts: pa.Table, lookup: pa.Table) -> pa.Table:
        m = Model(**held.value)
        word, c, cost = (lookup.column(x).to_numpy() for x in ("word", "c", "cost"))
        o = np.argsort(word)
        word, c, cost = word[o], c[o], cost[o]
        scale = np.log10(train_tokens + 0.1 * (distinct + 1))
        whole = []
        text = pa.concat_arrays(texts.column("text").chunks).cast(pa.large_string())
        for lo, hi in block_ranges(text, HASHED_BYTES):
            block = Words(text.slice(lo, hi - lo))
            at = np.searchsorted(word, block.hash)
            seen, wb = c[at], block.bounds
            base = per_doc(np.log10(seen + 0.1), wb) + np.log10(ends + 0.1) - (block.n + 1) * scale
            key, bounds = block.first_keys()
            kind, back = np.unique(key, return_inverse=True)
            score = per_doc(cost[at], wb) + per_doc(m.cost(kind & 0xFF, first_contexts(kind))[back], bounds)
            size = per_doc(block.e - block.s + 1, wb) + 1
            whole.append((block.n + 1, per_doc(seen > 0, wb) + (1 if ends else 0), base, score,
                          -score / np.log10(2) / size))
        tokens, n_known, base, score, bits = (np.concatenate(x) for x in zip(*whole))
        learned = texts.column("learn").to_numpy()
        give_back()
        return pa.table([texts.column("doc_id"), pa.array(~learned), pa.array(tokens, pa.int64()),
                         pa.array(n_known, pa.int64()), pa.array(np.full(len(text), train_tokens, np.int64)),
                         pa.array(base), pa.array(score), pa.array(bits)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                               "bits_per_byte"])
    return d.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(
        scored, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {RESULT}")
