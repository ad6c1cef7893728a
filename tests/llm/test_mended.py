"""Odd columns, odd texts and bounds of the operators that are tested elsewhere for their results."""

import math
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import (bpe, crf, decontaminate, labelled, langid, mixing, nbsvm, repetition, secrets, sharding,
                        simhash, text)

CLASH = ["__winner", "__hits_0", "__contamination", "__quality", "score", "hits", "r", "fp", "low", "root", "bucket",
         "learn", "word", "n", "c", "cost", "id", "y", "fit", "slot", "sample", "shard", "law", "size", "spans",
         "label", "component_id", "fingerprint", "ids", "held_out", "predicted", "p", "k", "b", "w"]


def clashing(df):
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASH if c not in df.columns})


REPORTS = {
    "op1": lambda d, l, b, v: bpe.report(d, v), "op2": lambda d, l, b, v: decontaminate.report(d, b),
    "op3": lambda d, l, b, v: simhash.groups(d), "op4": lambda d, l, b, v: nbsvm.report(d, l),
    "op5": lambda d, l, b, v: mixing.report(d), "op6": lambda d, l, b, v: langid.report(d),
    "op7": lambda d, l, b, v: sharding.report(d), "op8": lambda d, l, b, v: repetition.report(d),
    "op9": lambda d, l, b, v: secrets.report(d), "op10": lambda d, l, b, v: crf.report(d, l)}


@pytest.mark.parametrize("name", ["op3", "op4", "op5", "op6", "op7", "op9"])
def test_reports_do_not_look_at_extra_columns(spark, docs, labels, sf, name):
    d = docs.limit(60)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = REPORTS[name](d, labels, bench, None)
    got = REPORTS[name](clashing(d), clashing(labels), clashing(bench), None)
    assert got.columns == want.columns
    key = [c for c in want.columns if dict(want.dtypes)[c] not in ("double", "float")]
    assert Counter(map(tuple, got.select(*key).collect())) == Counter(map(tuple, want.select(*key).collect()))


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_extra_columns(spark, docs, sf, k):
    name, stage = corpus_pipeline.STAGES[k]
    d = docs.limit(80)
    want = stage(spark, d, sf)
    got = stage(spark, clashing(d), sf)
    extra = [c for c in CLASH if c not in d.columns]
    assert set(got.columns) == set(d.columns) | set(extra)
    assert got.select(*[F.col(c) == f"extra {c}" for c in extra]).distinct().count() == 1
    assert Counter(map(tuple, got.select(*d.columns).collect())) == Counter(map(tuple, want.select(*d.columns).collect()))


# ------------------------------------------------------------------ 2

def test_an_item_without_id_is_hit_and_removed(spark):
    b = spark.createDataFrame([(None, "alpha beta gamma"), (7, "delta epsilon")], "item_id long, text string")
    d = spark.createDataFrame([(1, "so alpha beta gamma it is"), (2, "delta epsilon alpha beta gamma"), (3, "clean")],
                              "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(d, b).collect()}
    assert got == {1: (3, 0, True), 2: (5, 1, True), 3: (0, 0, False)}
    assert [r.doc_id for r in decontaminate.remove_documents(d, b).collect()] == [3]
    assert [r.doc_id for r in decontaminate.remove_documents(clashing(d), clashing(b)).collect()] == [3]


# ------------------------------------------------------------------ 4, 10

def test_long_labelled_texts_are_learned_from(spark):
    """All texts of one class are long: both classes are in the sample, and the scores differ."""
    words = [f"w{k}" for k in range(40)]

    def text(i, y):
        if y:
            return " ".join(words[(i * 7 + j) % 40] for j in range(30))
        return " ".join(f"x{(i * 31 + j) % 30_000}#" for j in range(30_000))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 0]
    docs = spark.createDataFrame([(i, text(i, i % 2)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in ids], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in nbsvm.report(docs, labels).collect()}
    assert all(got[i] > 0.5 if i % 2 else got[i] < 0.5 for i in ids)


def test_sample_is_bounded_and_does_not_depend_on_order(spark, monkeypatch):
    monkeypatch.setattr(labelled, "LONG_VALUE", 8)
    rows = [(k % 2, bytes([k]) * (4 if k % 3 else 16)) for k in range(60)] + [(1, b"z" * 100)] * 2
    def taken(part):
        s = labelled._Sample(spark.createDataFrame(part, "y int, sample binary"), 40)
        return s.y, [bytes(s[i]) for i in range(len(s))]
    y, got = taken(rows)
    assert (y, got) == taken(rows[::-1])
    short = [x for x in rows if len(x[1]) <= 8]
    assert Counter(zip(y, got)) >= Counter(short)
    for c in (0, 1):
        long = sum(len(x) for k, x in zip(y, got) if k == c and len(x) > 8)
        assert 0 < long <= 40 or sum(len(x) > 8 for k, x in zip(y, got) if k == c) == 1
    y, got = taken([(0, b"a" * 100), (0, b"b" * 100)])
    assert len(got) == 1                                   # a class of long rows only keeps one at least


# ------------------------------------------------------------------ 5

def test_words_with_control_bytes_are_kept_apart(spark):
    texts = ["a\x00b", "a\x01b", "a\x01b a\x02b", "plain \x00\x01"]
    d = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {r.doc_id: r for r in mixing.report(d).collect()}
    assert set(got) == {f"t{i}" for i in range(4)}         # ids of any type, as they are
    learn = [t.split() for i, t in enumerate(texts) if zlib.crc32(f"t{i}".encode()) % 10 != 0]
    count = Counter(w for t in learn for w in [*t, None])
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        want = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*t.split(), None])
        assert got[f"t{i}"].base_score == pytest.approx(want)


# ------------------------------------------------------------------ 8

def test_longest_repeats_without_levels_are_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abc"), int(n))) for n in rng.integers(0, 90, 40)]
    texts += ["x " * 300, "", "one two three four five six seven eight nine ten " * 4]
    want = repetition.measure(pa.array(texts)).to_pylist()
    monkeypatch.setattr(repetition, "LEVEL_ENTRIES", 0)
    assert repetition.measure(pa.array(texts)).to_pylist() == want


def test_a_very_long_repeated_word_takes_memory_in_proportion():
    import tracemalloc
    n = 1_000_000                                          # 5 MB of one word
    arr = pa.array(["word " * n], pa.large_string())
    tracemalloc.start()
    got = repetition.measure(arr).to_pylist()[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got["n_words"], got["longest_repeat"], got["n_covered"]) == (n, n - 1, n)
    assert peak < 400e6


# ------------------------------------------------------------------ 6

def test_languages_of_other_letters_are_told_apart(spark):
    """Two languages whose letters lie 37 code points apart and follow the same pattern."""
    rng = np.random.default_rng(6)

    def text(first):
        return " ".join("".join(chr(first + int(c)) for c in rng.integers(0, 20, 6)) for _ in range(8))
    rows = [(i, text(0x0561 if i % 2 else 0x0561 - 37 * 5), "xa" if i % 2 else "xb") for i in range(200)]
    got = {r.doc_id: r for r in langid.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)


def test_rare_letters_share_a_symbol_and_add_up_to_one():
    letter = langid.letter_table()
    point = np.flatnonzero(letter)[1000:1400]
    a = langid.alphabet(point, np.arange(1, 401), int(letter.sum()))
    codes = np.concatenate([[0], np.flatnonzero(letter)])
    symbol, price = langid.translate(codes, a)
    assert sorted(np.bincount(symbol, minlength=64)[:63].tolist()) == [1] * 63 and symbol[0] == 0
    assert np.exp(price[symbol == langid.OTHER]).sum() == pytest.approx(1)
    assert (symbol[np.isin(codes, point[-62:])] < langid.OTHER).all()


@pytest.mark.parametrize("letters", [3, 90_000])
def test_windows_are_those_of_the_texts(letters):
    """Also with more letters in one block than fit a packed key."""
    letter = langid.letter_table()
    pool = [chr(c) for c in np.flatnonzero(letter) if chr(c).lower() == chr(c)][:letters]
    rng = np.random.default_rng(7)
    texts = ["".join(pool) + " 1 " + "".join(rng.choice(pool, 500)), None, "", "12", "  " + pool[0] + "-" + pool[1] + "!"]
    point, bounds, has = langid.characters(texts, letter)
    codes, cols, at = langid.windows(point, bounds)
    assert has.tolist() == [True, False, False, False, True]
    got = codes[cols[::-1, at]].T.tolist()
    want = []
    for t in texts:
        seq = [0] * 3
        for c in t or "":
            if c.isalpha():
                seq.append(ord(c))
            elif seq[-1]:
                seq.append(0)
        want += [seq[i - 3:i + 1] for i in range(3, len(seq))]
    assert got == want and len(set(map(tuple, cols.T.tolist()))) == cols.shape[1]


def test_few_of_a_languages_own_documents_are_rejected_and_junk_is(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = spark.createDataFrame([(10**7 + i, "xq zvkj wqpx jjqz vxkq zzqw qxjv kzxq " * 3, None) for i in range(10)],
                                 "doc_id long, text string, lang string")
    rows = langid.report(d.select("doc_id", "text", "lang").unionByName(junk)).collect()
    assert all(r.rejected for r in rows if r.doc_id >= 10**7)
    real = [r.rejected for r in rows if r.doc_id < 10**7 and r.lang_pred != "und"]
    assert sum(real) <= 0.02 * len(real)


def test_mixing_weights_learn_from_every_word_and_key(spark):
    words = [f"{k:x}" for k in range(30_000)]                # more than the sample of before
    v = spark.createDataFrame([(w, 1) for w in words], "word_text string, c long").coalesce(1)
    keys = spark.createDataFrame([(97 + k % 26 + (k << 8), 2) for k in range(1000)], "word long, c long").coalesce(1)
    counts = np.zeros((mixing.SLOTS, 2), np.float32)
    got = mixing.mixed_pass(v, keys, mixing.Mixer.new(), spark.sparkContext.broadcast(counts), 2048, 2)
    byte, *_ = mixing.distinct_cases(pa.array(words, pa.large_string()))
    assert got.seen.sum() >= 8 * (len(byte) + 1000)          # beginnings in two batches count twice
    assert np.isfinite(got.weight).all() and (got.speed >= 1).all() and (got.refine > 0).all() and (got.refine < 1).all()
    # one task alone moves as it does by itself; of two the moves are averaged by use
    alone, start = mixing.Mixer.new(), mixing.Mixer.new()
    key = np.array([97, 98 | 97 << 8], np.int64)
    alone.learn(counts, key & 0xFF, mixing.first_contexts(key), np.array([3, 1]), 128)
    far, use = alone.moves(start)
    assert np.allclose(start.moved(far, use, 1).weight, alone.weight)
    assert np.allclose(start.moved(far + far, use + use, 2).refine, alone.refine)


def test_language_limits_come_from_all_documents(spark):
    rng = np.random.default_rng(3)
    values = {"x": np.round(rng.gamma(3, 1, 9000), 3), "y": np.full(5000, 2.5), "z": np.array([1.0, 4.0])}
    rows = [(k, float(x)) for k, v in values.items() for x in v]
    own = spark.createDataFrame(rows, "lang string, entropy double")
    got = langid.limits(own, ["w", "x", "y", "z"])
    want = [np.quantile(values[k], 1 - langid.FALSE_REJECT) for k in "xyz"]
    assert np.isinf(got[0]) and np.allclose(got[1:], want, rtol=1e-12)


def learned_plainly(mixer, counts, byte, contexts, n, batch, rate=0.05):
    """``Mixer.learn`` written out: one table row, weight row and map entry a case."""
    at_gate = np.log1p(np.array(mixing.GATES)) / np.log1p(mixing.GATES[-1]) - 1e-3
    side = len(mixing.GATES) + 1
    for lo in range(0, len(byte), batch):
        part = slice(lo, lo + batch)
        m = n[part].astype(np.float64)
        for depth, node, bit, slots in mixing.bits_of(byte[part], [c[part] for c in contexts]):
            c = counts[slots].astype(np.float64)
            c[..., 0] = np.maximum(c[..., 0] - (1 - bit), 0.0)
            c[..., 1] = np.maximum(c[..., 1] - bit, 0.0)
            x = mixing.Model.stretched(c)
            word, order = (np.searchsorted(at_gate, x[k, :, 1], side="right") for k in (-1, -2))
            gate = (depth * side + word) * side + order
            w = mixer.weight[gate]
            st = w[:, -1] + (x[..., 0] * (w[:, :-1:2].T + x[..., 1] * w[:, 1:-1:2].T)).sum(axis=0)
            st = np.clip(st, -8, 8)
            err = (bit - 1 / (1 + np.exp(-st))) * m
            x[..., 1] *= x[..., 0]
            flat = np.concatenate([x.transpose(1, 0, 2).reshape(len(err), -1), np.ones((len(err), 1))], axis=1)
            g = np.zeros_like(mixer.weight)
            np.add.at(g, gate, flat * err[:, None])
            mixer.speed += g * g
            mixer.weight += rate * g / np.sqrt(mixer.speed)
            b, frac = mixing.Model.bins(st)
            at = (node, np.where(frac > 0.5, b + 1, b))
            np.add.at(mixer.refine, at, 0.02 * (bit - mixer.refine[at]))
            np.add.at(mixer.seen, at, 1.0)
            np.clip(mixer.refine, 0.0005, 0.9995, out=mixer.refine)


def test_mixing_learns_the_same_in_half_the_time():
    rng = np.random.default_rng(9)
    words = pa.array(["".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 9))) for _ in range(6000)], pa.large_string())
    byte, ctx, at, word = mixing.distinct_cases(words)
    many = np.bincount(at, weights=rng.integers(1, 3000, len(words))[word], minlength=len(byte))
    counts = np.zeros((mixing.SLOTS, 2))
    mixing.add_counts(counts, byte, ctx, many)
    counts = counts.astype(np.float32)
    took, made = [], []
    for f in (learned_plainly, mixing.Mixer.learn):
        best = np.inf
        for _ in range(3):
            mixer, began = mixing.Mixer.new(), time.process_time()
            f(mixer, counts, byte, ctx, many, 2048)
            best = min(best, time.process_time() - began)
        took.append(best)
        made.append(mixer)
    for k in ("weight", "speed", "refine", "seen"):
        assert np.allclose(getattr(made[0], k), getattr(made[1], k), rtol=1e-9), k
    assert took[1] < 0.5 * took[0], took


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labelled_join_keeps_the_python_stages_apart(spark, docs):
    labels = spark.createDataFrame([(r.doc_id, r.doc_id % 2) for r in docs.select("doc_id").collect()],
                                   "doc_id long, quality int")
    rows = labelled.training_rows(docs, labels, "quality", 5, 0, 4000)
    rows.collect()
    assert "BroadcastHashJoin" not in plan_of(rows) and "SortMergeJoin" in plan_of(rows)
    assert rows.count() == labels.filter("crc32(cast(doc_id as string)) % 5 != 0").count()


def test_blocks_of_texts_take_little_memory():
    arr = pa.array(["a few words of text, told apart by 123 " * 50] * 4000, pa.large_string())      # 8 MB
    for f, most in ((nbsvm.features, 32), (lambda a: mixing.Words(a).first_keys(), 32), (simhash.fingerprints, 96)):
        tracemalloc.start()
        for part in text.blocks(arr, text.HASHED_BYTES):
            f(part)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most << 20, peak
