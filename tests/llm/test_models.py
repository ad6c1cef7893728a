"""Classifiers (4, 10), LM scoring (5) and language id (6)."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import crf, langid, mixing, nbsvm
from tests.llm.conftest import ODD


def held_out(i, mod, rest):
    return i is not None and zlib.crc32(str(i).encode()) % mod == rest


def accuracy(got, labels, col):
    y = {r.doc_id: r[col] for r in labels.collect()}
    rows = [r for r in got.collect() if r.held_out and r.doc_id in y]
    return sum(r.predicted == y[r.doc_id] for r in rows) / len(rows), rows


@pytest.mark.parametrize("mod,col,thr", [(nbsvm, "quality", 0.3), (crf, "toxic", 0.5)])
def test_classifiers_on_held_out_rows(spark, mod, col, thr):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = mod.report(spark.read.parquet(f"{d}/documents.parquet"), labels).cache()
    share, rows = accuracy(got, labels, col)
    assert share >= 0.93 and len(rows) > 50
    for r in got.collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= thr) and r.held_out == held_out(r.doc_id, 5, 0)


@pytest.mark.parametrize("mod,col", [(nbsvm, "quality"), (crf, "toxic")])
def test_classifiers_take_odd_rows(spark, docs, labels, odd, none, mod, col):
    got = mod.report(odd, labels.unionByName(spark.createDataFrame(
        [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None), (6, 7, 7)], labels.schema)))
    rows = got.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ODD)
    assert all(0 <= r.score <= 1 for r in rows)
    same = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(same) == 1                                       # null, empty and blank texts score alike
    assert mod.report(none, labels).count() == 0
    empty = mod.report(odd, labels.limit(0)).collect()          # nothing learned: one score for all
    assert {r.score for r in empty} == {0.5}
    one = mod.report(docs, labels.filter(F.col(col) == 0)).collect()
    assert len({r.score for r in one}) == 1 and one[0].score < 0.2


def test_labels_of_held_out_rows_are_not_used(spark, docs, labels):
    lab = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0,
                                              1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in nbsvm.report(docs, labels).collect()}
    b = {r.doc_id: r.score for r in nbsvm.report(docs, lab).collect()}
    assert a == b


def test_dual_coordinate_descent_reaches_the_optimum():
    """The primal and dual objectives meet on a small separable and noisy problem."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ rng.normal(size=5) + rng.normal(size=60) * 0.5 > 0, 1, -1)
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = np.full(60, 1.0)
    w, b = nbsvm.dual_coordinate_descent([(np.arange(5), r) for r in x], y, c, 5, epochs=3000)
    primal = 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = min(0.5 * ((w + e) @ (w + e) + (b + f) ** 2) + np.maximum(0, 1 - y * (x @ (w + e) + b + f)).sum()
               for e, f in zip(rng.normal(size=(500, 5)) * 0.05, rng.normal(size=500) * 0.05))
    assert primal <= best + 1e-3


def test_crf_marginals_by_enumeration():
    """Forward-backward over several documents equals sums over all taggings."""
    import itertools
    rng = np.random.default_rng(1)
    bounds = np.array([0, 4, 4, 5, 9])
    unary, pair = rng.normal(size=9), rng.normal(size=(2, 2))
    p, pairs = crf.marginals(unary, pair, bounds)
    at = 0
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        n, total = hi - lo, 0.0
        one, two = np.zeros(n), np.zeros((max(n - 1, 0), 2, 2))
        for tags in itertools.product((0, 1), repeat=n):
            s = math.exp(sum(unary[lo + i] * t for i, t in enumerate(tags))
                         + sum(pair[a, b] for a, b in zip(tags, tags[1:])))
            total += s
            for i, t in enumerate(tags):
                one[i] += s * t
            for i, (a, b) in enumerate(zip(tags, tags[1:])):
                two[i, a, b] += s
        if n:
            assert np.allclose(p[lo:hi], one / total)
            assert np.allclose(pairs[at:at + n - 1], two / total)
            at += n - 1
    long = crf.marginals(rng.normal(size=3000), pair, np.array([0, 1000, 3000]))[0]   # many lanes
    assert np.isfinite(long).all()


def test_crf_spans_point_at_the_words(spark):
    model = crf.Model(np.zeros(crf.SLOTS, np.float32), -5.0, np.zeros((2, 2)), np.array([1.0, 1.0, 0.0]))
    _, _, _, _, _, slots = crf.tokens(pa.array(["trash"]))
    model.weight[slots[0]] = 5.0
    text = "Ünï 😀 Trash! and more trash"
    got = model.column(pa.array([None, text, ""])).to_pylist()
    assert [text[s["start"]:s["stop"]] for s in got[1]["spans"]] == ["Trash", "trash"]
    assert got[0] == got[2] and got[0]["spans"] == []


def test_crf_knows_toxic_words_outside_its_sample(spark):
    """Rare toxic words, most of them in no sampled text: all labelled rows tell them."""
    import random
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    bad, common = [word() for _ in range(60)], [word() for _ in range(300)]
    rows = []
    for i in range(6000):
        t = [rng.choice(common) for _ in range(12)]
        if i < 600:
            t[rng.randrange(12)] = bad[i % 60]
        rows.append((i, " ".join(t), int(i < 600)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = crf.fit(df, df, per_class=40)
    got = crf.score(df.filter("crc32(cast(doc_id as string)) % 5 = 0"), model).collect()
    toxic = [r for r in got if r.toxic]
    found = [r for r in toxic if r.toxicity.score >= 0.5
             and [r.text[s.start:s.stop] for s in r.toxicity.spans] == [w for w in r.text.split() if w in bad]]
    assert len(toxic) > 80 and len(found) >= 0.95 * len(toxic)
    assert sum(r.toxicity.score >= 0.5 for r in got if not r.toxic) <= 0.01 * len(got)


# -- 5 ---------------------------------------------------------------------------

def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def check_base(rows, got):
    cn = Counter()
    for i, t in rows:
        if not held_out(i, 10, 0):
            cn.update(words(t))
            cn[None] += 1
    n, v = sum(cn.values()), len(cn)
    want = sorted((str(i), held_out(i, 10, 0), len(words(t)) + 1, sum(cn[w] > 0 for w in [*words(t), None]), n,
                   round(sum(math.log10((cn[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None]), 4))
                  for i, t in rows)
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)
    assert have == want


def test_mixing_base_by_brute_force(spark, docs, odd, none):
    got = mixing.report(docs).collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], got)
    held = [r for r in got if r.held_out]
    assert sum(r.bits_per_byte for r in held) / len(held) < 3.2      # bytes as they are take 8 bits
    check_base(ODD, mixing.report(odd).collect())
    assert mixing.report(none).count() == 0


def test_mixing_probabilities_add_up():
    """After any context the 256 next bytes' probabilities sum to one."""
    rng = np.random.default_rng(2)
    counts = np.zeros((mixing.SLOTS, 2), np.float32)
    texts = pa.array(["the", "then", "there", "thé", "of"], pa.large_string())
    byte, ctx, word = mixing.inner_cases(texts)
    mixing.add_counts(counts, byte, ctx, np.ones(len(byte)))
    m = mixing.learn(counts, byte, ctx, np.ones(len(byte), np.int64))
    one = [c[2:3] for c in ctx]
    p = 10 ** m.cost(np.arange(256), [np.repeat(c, 256) for c in one])
    assert abs(p.sum() - 1) < 1e-3
    assert rng is not None and m.word_costs(texts).shape == (5,)
    whole = m.word_costs(texts)
    alone = [m.word_costs(texts.slice(i, 1))[0] for i in range(5)]
    assert np.allclose(whole, alone)


def test_mixing_first_keys():
    w = mixing.Words(pa.array(["Ab cde", "", "x"], pa.large_string()))
    key, bounds = w.first_keys()
    b = lambda s: int.from_bytes(s[::-1].encode(), "big")
    assert bounds.tolist() == [0, 3, 4, 6]
    assert key.tolist() == [b("a"), b("cba"), b("\0edc"), 0, b("x"), b("\0x")]


# -- 6 ---------------------------------------------------------------------------

def test_language_held_out(spark, docs):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: r.lang for r in d.collect()}
    got = [r for r in langid.report(d).collect() if r.held_out]
    assert sum(r.lang_pred == want[r.doc_id] for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark, docs, odd, none):
    blank = odd.withColumn("lang", F.lit(None).cast("string"))
    got = {r.doc_id: r for r in langid.report(docs.select("doc_id", "text", "lang").unionByName(
        blank.withColumn("doc_id", F.col("doc_id") + 10**6).select("doc_id", "text", "lang"))).collect()}
    assert [got[10**6 + i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert got[10**6 + 4].lang_pred in {"en", "de", "fr", "es"} and got[10**6 + 6].lang_pred == "en"
    assert {r.lang_pred for r in langid.report(blank).collect()} == {"und"}       # nothing learned
    assert langid.report(none).count() == 0


def test_kneser_ney_is_a_distribution():
    """For seen and unseen contexts the symbols' probabilities add up to one."""
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 4, 400) | rng.integers(0, 4, 400) << 6 | rng.integers(0, 4, 400) << 12
                    | rng.integers(0, 3, 400) << 18)
    m = langid.Model(["x"], [langid.kneser_ney(key, rng.integers(1, 9, len(key)))], np.zeros(1))
    for ctx in (1 | 2 << 6 | 1 << 12, 60 | 2 << 6 | 3 << 12, 61 | 61 << 6 | 61 << 12):
        p = np.exp(m.log_prob((ctx << 6) + np.arange(64))[0])
        assert abs(p.sum() - 1) < 1e-9


def test_filter_of_labelled_ids_loses_no_row(spark):
    from larder.llm import labelled
    docs = spark.range(0, 20_000).withColumn("text", F.lit("x"))
    ids = spark.range(0, 20_000, 7).union(spark.createDataFrame([(-5,), (1 << 60,)], "id long"))
    kept = {r.id for r in labelled.maybe_labelled(docs, ids).collect()}
    assert {i for i in range(0, 20_000, 7)} <= kept and len(kept) < 4000
    assert labelled.maybe_labelled(docs, ids.limit(0)).count() == 0
