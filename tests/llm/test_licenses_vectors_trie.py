"""License templates (11), whitening (12) and the conversation trie (13)."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import licenses, trie, whitening
from larder.llm.license_templates import TEMPLATES
from tests.llm.conftest import ODD

CLASH = ["_x", "w", "r", "pos", "col", "license", "whitening", "key", "conv", "pid", "doc", "n_words", "top", "shard"]


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASH if c not in df.columns})


# ------------------------------------------------------------------ 11

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def by_hand(text):
    words = WORD.findall(lower(text or ""))
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                base.add(label)
    joined = " " + " ".join(words) + " "
    own = {label for label, markup in TEMPLATES if re.search(licenses.pattern(markup), joined)}
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if own else 0.5 if base else 0.0)


def filled(markup, optional, n):
    """A text of the template: optional regions in or out, ``n`` words in each replaceable one."""
    def part(p):
        if isinstance(p, str):
            return [p]
        if isinstance(p, list):
            return [w for q in p for w in part(q)] if optional else []
        return ["filler"] * max(p[0], min(n, p[1]))
    return [w for p in licenses.parse(markup) for w in part(p)]


def scanned(texts):
    return licenses.Scanner().scan(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize("label,markup", TEMPLATES)
def test_templates_accept_their_own_texts_and_no_changed_wording(label, markup):
    for optional in (True, False):
        for n in (0, 3, 99):
            words = filled(markup, optional, n)
            got = scanned([f"before {' '.join(words)} after"])[0]
            assert label in got["labels"].split(",") and got["score"] == 1.0
            assert any(s["label"] == label and s["stop"] <= len(words) + 1 for s in got["spans"])
    words = filled(markup, False, 1)
    k = len(words) // 2
    for changed in (words[:k] + ["zzz"] + words[k + 1:], words[:k] + words[k + 1:], words[1:k + 1]):
        a = compile_and_run(label, markup, changed)
        expected = re.search(licenses.pattern(markup), " " + " ".join(changed) + " ") is not None
        assert a == expected


def compile_and_run(label, markup, words):
    got = licenses.Scanner([(label, markup)], []).scan(pa.array([" ".join(words)])).to_pylist()[0]
    return bool(got["spans"])


def test_optional_replaceable_and_longest():
    s = licenses.Scanner([("x", "[[The [[very]]]] big {{1-3}} house [[of cards]]")], [])
    def spans(text):
        return [(t["start"], t["stop"]) for t in s.scan(pa.array([text])).to_pylist()[0]["spans"]]
    assert spans("the very big old house") == [(0, 5)]
    assert spans("very big old house of cards") == [(1, 6)]
    assert spans("big house") == [] and spans("big a b c d house") == []
    assert spans("big a house house of cards") == [(0, 6)]
    assert spans("big a house, BIG b\nhouse!") == [(0, 3), (3, 6)]
    with pytest.raises(ValueError):
        licenses.compile_template("x", "[[all optional]]")
    with pytest.raises(ValueError):
        licenses.compile_template("x", "open [[region")


def test_scan_of_documents(spark, docs, odd, none):
    texts = docs.select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in licenses.report(clashing(docs)).collect()}
    assert got == {r.doc_id: by_hand(r.text) for r in texts}
    assert any("apache-2.0" in v[5] for v in got.values())
    rows = Counter(tuple(r) for r in licenses.report(clashing(odd)).collect())
    assert rows == Counter((i, *by_hand(t)) for i, t in ODD)
    assert licenses.report(none).collect() == []


def test_long_text_and_many_false_starts(spark):
    text = "permission is hereby granted " * 40_000 + "under the mit license " * 3
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = licenses.report(d).first()
    assert (r.n_words, r.n_base, r.first_word, r.labels) == (160_012, 3, 160_002, "mit")


# ------------------------------------------------------------------ 12

def spectra():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        a = rng.normal(size=(3 * n, n))
        yield a.T @ a
        a[:, n // 2:] = 0
        yield a.T @ a                                     # half the eigenvalues are zero
        yield np.eye(n) * 3                               # all equal
        b = rng.normal(size=(3 * n, n)) * np.logspace(0, -4, n)
        yield b.T @ b
        q = np.linalg.qr(rng.normal(size=(n, n)))[0]
        yield q @ np.diag(np.repeat([5.0, 2.0, 1.0], n)[:n]) @ q.T + 1e-9 * np.eye(n)


@pytest.mark.parametrize("v", list(spectra()), ids=lambda v: str(len(v)))
def test_spectrum_equals_dense_solution(v):
    e = np.linalg.eigvalsh(v)[::-1]
    s = whitening.leading(v, 12)
    k = len(s.values)
    assert k == min(12, int((e > len(v) * whitening.RANK * e[0]).sum())) and s.certified
    assert np.allclose(s.values, e[:k], rtol=0, atol=1e-13 * max(e[0], 1e-300) * len(v))
    assert np.allclose(s.vectors @ s.vectors.T, np.eye(k), atol=1e-12)
    assert np.abs(v @ s.vectors.T - s.vectors.T * s.values).max(initial=0) <= 1e-12 * e[0] * len(v)
    for shift in np.linspace(e[-1], e[0], 9)[1:-1] * 1.000123:
        assert whitening.inertia(v, shift) == (e > shift).sum()


def test_inertia_of_indefinite_matrices():
    rng = np.random.default_rng(6)
    for n in (2, 3, 9, 30):
        a = rng.normal(size=(n, n))
        a = a + a.T
        assert whitening.inertia(a, 0.3) == (np.linalg.eigvalsh(a) > 0.3).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def whitened_by_hand(vectors):
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    y = x - s / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    return n, (d * d).sum(axis=1), e[::-1], q[:, ::-1], y, np.trace(v)


def test_whitening_of_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    src = df.collect()
    n, dev, e, q, y, trace = whitened_by_hand([r.embedding for r in src])
    rows = whitening.report(clashing(df)).collect()
    assert len(rows) == 32 * n
    w = np.zeros((n, 32))
    at = {r.vec_id: k for k, r in enumerate(src)}
    for r in rows:
        assert r.n == n and r.deviation == dev[at[r.vec_id]] and r.identity_error < 1e-9
        assert abs(r.explained - e[r.component - 1] / trace) < 1e-12
        w[at[r.vec_id], r.component - 1] = r.whitened
    for k in range(32):
        truth = y @ q[:, k] / np.sqrt(e[k])
        assert min(np.abs(w[:, k] - truth).max(), np.abs(w[:, k] + truth).max()) < 1e-8
    assert np.abs(w.T @ w / n - np.eye(32)).max() < 1e-9


def test_vectors_that_drop_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (None, [3.0, -1.0]),
            (5, [0.0, -inf]), (6, [1.0]), (7, []), (8, [2.5, 2.5]), (9, [1e300, 0.0]), (10, [1e12, 4.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = whitening.report(df).collect()
    kept = [(i, v) for i, v in rows if i in (1, None, 8, 10)]
    # beside an entry of 1e12 the second eigenvalue is zero to double precision
    assert Counter((r.vec_id, r.component, r.n) for r in got) == Counter((i, 1, 5) for i, _ in kept)
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in kept]
    s = [sum(c) for c in zip(*x)]
    dev = [sum((5 * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 1 << 63 else None for (i, _), d in zip(kept, dev)}
    assert whitening.report(df.limit(0)).collect() == []
    assert whitening.report(df.filter("vec_id = 1")).collect() == []       # equal vectors: nothing to whiten
    assert whitening.report(df.filter("vec_id = 2")).collect() == []
    model = whitening.fit(df)
    assert whitening.whiten(df, model).filter("whitening is null").count() == 7


# ------------------------------------------------------------------ 13

def trie_by_hand(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        full[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    out = []
    for node, m in members.items():
        below = [k for k in members if k[:len(node)] == node]
        ends = ",".join(str(c) for c in m if len(full[c]) == len(node))
        out.append((m[0], len(node), members[node[:-1]][0] if node else None, len(m),
                    sum(len(k) == len(node) + 1 for k in below),
                    sum(not any(j[:-1] == k for j in below if j) for k in below),
                    sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


SCHEMA = "conv_id long, turn long, role string, text string"
TALKS = [(0, 0, "u", "hi"), (0, 1, "a", "yo"), (0, 1, "a", "yo"), (0, None, None, None), (None, 1, "u", "x"),
         (1, 3, "u", "ü\U0001F600"), (2, 0, "u", "hi"), (100, 5, "u", "only"), (105, 0, "u", "hi"),
         (-7, 0, "u", "neg"), (-107, 0, "u", "n"), (3, 1, "b", "tie"), (3, 1, "a", "tie"), (3, 1, "a", "tie"),
         (7, None, "u", "x"), (7, None, "u", ""), (250, 1, "u", "z")]


@pytest.mark.parametrize("limits", [{}, {"light": 1, "band": 1, "queue": 1}, {"light": 2, "band": 3, "queue": 2}])
def test_trie_of_odd_conversations(spark, limits):
    df = clashing(spark.createDataFrame(TALKS, SCHEMA))
    got = trie.report(df, **limits)
    assert Counter(tuple(r) for r in got.collect()) == trie_by_hand(TALKS)
    assert all(t == "bigint" for c, t in got.dtypes if c != "ends_sha256")


def test_trie_of_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in trie.report(df).collect()) == trie_by_hand(rows)
    assert trie.report(df.limit(0)).collect() == []


def test_trie_with_a_conversation_over_many_tasks(spark):
    rows = [(200, i, "u", f"t{i % 7}") for i in range(300)]                  # most rows belong to one id
    rows += [(c, i, "u", f"t{i % 7}") for c in range(30) for i in range(c % 5 + 3)]
    rows += [(400 + c, i, "u", "same") for c in range(40) for i in range(4)]       # copies
    got = trie.report(spark.createDataFrame(rows, SCHEMA), light=4, band=90, queue=8)
    assert Counter(tuple(r) for r in got.collect()) == trie_by_hand(rows)


def test_spilling_queue_returns_messages_in_order():
    rng = np.random.default_rng(2)
    q, left, out = trie.SpillingQueue(limit=5, most_runs=3), [], []
    for k in range(600):
        item = (int(rng.integers(-9, 0)), int(rng.integers(0, 99)).to_bytes(16), k, 2 * k)
        q.push(item)
        left.append(item)
        if k % 3 == 0:
            left.sort()
            assert q.peek() == left[0]
            out.append(q.pop())
            assert out[-1] == left.pop(0)
    while q.peek() is not None:
        out.append(q.pop())
    assert q.spilled > 0 and len(out) == 600 and out[-len(left):] == sorted(left)


def test_trie_sql(spark, sf):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = trie.report(spark.read.parquet(f"{sf}/conversations.parquet")).collect()
    assert Counter(map(tuple, got)) == Counter(con.execute(trie.sql()).fetchall())
    got = licenses.report(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert Counter(map(tuple, got)) == Counter(con.execute(licenses.sql()).fetchall())
