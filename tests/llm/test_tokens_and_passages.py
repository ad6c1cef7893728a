"""BPE (1), decontamination (2) and SimHash (3) against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm import bpe, decontaminate, simhash
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# -- 1 ---------------------------------------------------------------------------

def check_bpe(spark, df, rows):
    t = Tokenizer.from_file(PATH)
    got = bpe.report(df, bpe.load(PATH)).collect()
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_bpe_matches_library(spark, docs, odd, none):
    check_bpe(spark, docs, [(r.doc_id, r.text) for r in docs.collect()])
    check_bpe(spark, odd, ODD)
    assert bpe.report(none, bpe.load(PATH)).count() == 0


def test_bpe_random_strings_and_specials():
    rng = random.Random(1)
    pool = list("abcdeé ÉΣσςİıſ文字 \t\u0085　\x1c'!?123½Ⅷ😀lo") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "aaaa"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 500, "aA" * 300, "x<|endoftext|>'s", "<|ENDOFTEXT|>"]
    got = bpe.Encoder(bpe.Vocabulary(bpe.load(PATH)))(pa.array(texts)).to_pylist()
    t = Tokenizer.from_file(PATH)
    for text, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_bpe_late_merges_go_one_at_a_time():
    """A vocabulary in which a merge's product takes part in a lower rank."""
    import json
    chars = bpe.byte_chars()
    vocab = {c: i for i, c in enumerate(chars)} | {c + "</w>": 256 + i for i, c in enumerate(chars)}
    merges = [("ab", "a"), ("a", "b"), ("b", "a"), ("aba", "b"), ("a", "a")]
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    spec = {"model": {"vocab": vocab, "merges": merges, "end_of_word_suffix": "</w>"}, "added_tokens": [],
            "pre_tokenizer": {"pretokenizers": [{"type": "Split", "pattern": {"Regex": r"[ab]+"}}]}}
    v = bpe.Vocabulary(json.dumps(spec))
    assert v.single.any()
    rank = {p: i for i, p in enumerate(merges)}

    def one_word(w):
        parts = [*w[:-1], w[-1] + "</w>"]
        while True:
            best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
            if best is None:
                return [vocab[p] for p in parts]
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    ids, offs = bpe.encode_words(v, [w.encode() for w in words])
    for w, a, b in zip(words, offs[:-1], offs[1:]):
        assert ids[a:b].tolist() == one_word(w), w


def test_bpe_keeps_columns_and_unpacks(spark):
    df = spark.createDataFrame([(1, "hello world", "x")], "doc_id long, text string, ids string")
    out = bpe.encode(df, bpe.load(PATH))
    assert out.columns == ["doc_id", "text", "ids"]
    ids = out.select(bpe.unpack().alias("u")).first().u
    assert ids == Tokenizer.from_file(PATH).encode("hello world", add_special_tokens=False).ids


# -- 2 ---------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=10):
    wins = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        if w:                                     # an item without id hits, but is in no list
            for j in range(max(1, len(w) - window + 1)):
                wins[tuple(w[j:j + window])].update([] if i is None else [str(i)])
    sizes = {len(k) for k in wins}
    out = []
    for i, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if tuple(w[j:j + k]) in wins:
                    hit.update(range(j, j + k))
                    found |= wins[tuple(w[j:j + k])]
        out.append((i, len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_brute_force(spark, docs, odd, none, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = decontaminate.report(docs, bench)
    want = contamination(rows, items)
    assert sorted(map(tuple, got.collect()), key=str) == want and any(r[5] for r in want)
    odd_items = [(1, "two"), (2, "ONE two"), (3, None), (4, "..."), (None, "a"), (5, "one two three"), (5, "one two three"),
                 (10, "word " * 12)]
    b = spark.createDataFrame([(i, t, 0) for i, t in odd_items], "item_id long, text string, doc_id int")
    assert sorted(map(tuple, decontaminate.report(odd, b).collect()), key=str) == contamination(ODD, odd_items)
    assert decontaminate.report(none, b).count() == 0
    assert decontaminate.report(odd, b.limit(0)).filter("contaminated").count() == 0


def test_decontamination_in_parts_is_the_same(spark, docs, sf):
    w = decontaminate.benchmark_windows(spark.read.parquet(f"{sf}/benchmark.parquet"))
    one = decontaminate.scan(docs, w).select("doc_id", "hits.n_words", F.array_sort("hits.hits"))
    many = decontaminate.scan(docs, w, max_windows=w.count() // 3).select("doc_id", "hits.n_words", F.array_sort("hits.hits"))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_decontamination_removes(spark):
    df = spark.createDataFrame([(1, "Keep this. ALPHA, beta! gamma end"), (2, "clean"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.remove_documents(df, b).orderBy("doc_id").collect()] == [2, 3]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(df, b).collect()}
    assert cut == {1: "Keep this.  end", 2: "clean", 3: None}


# -- 3 ---------------------------------------------------------------------------

def fingerprint(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
    sh = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=4):
    fps = [fingerprint(t) for _, t in rows]
    root = {f: f for f in set(fps)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ds = sorted(root)
    for i, a in enumerate(ds):
        for b in ds[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    low = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return sorted(((i, f"{f:016x}", low.get(find(f))) for (i, _), f in zip(rows, fps)), key=str)


def test_simhash_brute_force(spark, docs, odd, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, simhash.groups(docs).collect()), key=str) == brute_groups(rows)
    assert sorted(map(tuple, simhash.groups(odd).collect()), key=str) == brute_groups(ODD)
    assert simhash.groups(none).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(3)
    ms = simhash.masks(4)
    assert len(ms) == 31
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(d & m == 0 for m in ms)


def test_links_connect_what_all_links_connect(spark):
    """Random fingerprints around a few centres, with buckets above and below the
    block size: components equal those of all pairs within the radius."""
    rng = random.Random(4)
    fps = set()
    for c in [rng.getrandbits(64) for _ in range(4)]:
        for _ in range(150):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 7)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    want = defaultdict(set)
    for f in fps:
        want[find(f)].add(f)
    want = {frozenset(v) for v in want.values() if len(v) > 1}
    for rows in (4096, 20):
        got = defaultdict(set)
        for r in simhash.components(simhash.links(df, bucket_rows=rows)).collect():
            got[r.root].add(r.node % (1 << 64))
        assert {frozenset(v | {k % (1 << 64)}) for k, v in got.items()} == want


def test_components_of_a_long_chain(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(df).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


def test_keep_one(spark, odd):
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.keep_one(odd).select("doc_id").collect())
    # 1, 2 and 3 have no words; 4 and 5 are copies, 4 twice; null id: its group has no other id
    assert got == [(False, 1), (False, 4), (False, 6), (False, 7), (False, 8), (True, 0)]
    assert simhash.keep_one(odd).columns == odd.columns
