"""Quality rules with suffix-array repetition (8).

For every document a suffix array over its words is built by prefix doubling
(all documents of a block at once; ranks never cross documents).  Two suffixes
that are neighbours in it share a longest common prefix (LCP); the maximal
repeated substrings are the LCP intervals' prefixes, and the longest repeat
that starts at a word is the larger LCP of its suffix and either neighbour.
Spans of repeats of ``min_words`` words or more are united; a document fails
when they cover too large a part of its words or when one repeat is too long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.text import (NON_SPACE, SpanHash, block_udf, cover, mix, only, per_doc, runs,
                             struct_array, utf8, window_hash, window_ok)

MIN_WORDS = 10          # shortest repeat that counts
MAX_COVERED = 0.25      # largest part of the words that repeats may cover; words in such repeats lie in repeated
                        # 3-word windows too, so at BASE_MAX_REPEAT or above it could never reject.  A repeat is
                        # shorter than what it covers, so this bounds the longest one by the text's length as well
MAX_REPEAT = 50         # longest repeat in words that a document may hold
BASE_MIN_WORDS = 50     # base rule: fewer words fail
BASE_MAX_REPEAT = 0.5   # base rule: larger part in repeated 3-word windows fails

LEVEL_ENTRIES = 1 << 23 # ranks that the levels of prefix doubling may hold; beyond, the LCP comes from the final order

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

_FIELDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(),
           "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "n_covered": pa.int64(),
           "longest_repeat": pa.int64(),
           "repeats": pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))}
RESULT = ("n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
          "n_covered:bigint,longest_repeat:bigint,repeats:array<struct<start:int,stop:int>>")


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a value occurs at least twice."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def suffix_repeats(words: np.ndarray, doc: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Per word position, the longest repeat in its document that starts there.

    ``words``: word hashes; ``doc``: document of each word; ``stop``: end of
    that document.  Prefix doubling gives, per level k, the rank of every
    suffix by its first 2^k words; only suffixes whose rank is shared are
    sorted again.  The LCP of neighbours follows from the levels, top down; where they
    would take more than LEVEL_ENTRIES they are not kept, and the LCP follows
    from the final order (a suffix shares at least one word less than the one
    before it), so memory stays in proportion to the words.
    """
    n = len(words)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    key = mix(words ^ (doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    order = np.argsort(key, kind="stable")
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, step, words_of = [rank], 1, rank
    count = np.bincount(rank, minlength=n)
    active = np.flatnonzero(count[rank] > 1)
    while len(active):
        nxt = active + step
        tail = np.where(nxt < stop[active], rank[np.minimum(nxt, n - 1)], -1)
        by = rank[active] * (n + 1) + tail + 1
        o = np.argsort(by, kind="stable")
        active, by = active[o], by[o]
        first = np.flatnonzero(np.concatenate([[True], rank[active][1:] != rank[active][:-1]]))
        at = np.arange(len(active))
        base = np.repeat(at[first], np.diff(np.concatenate([first, [len(active)]])))
        head = np.concatenate([[True], by[1:] != by[:-1]])
        group = np.maximum.accumulate(np.where(head, at, 0))
        new = rank.copy()
        new[active] = rank[active] + group - base
        rank, step = new, 2 * step
        if levels and (len(levels) + 1) * n <= LEVEL_ENTRIES:
            levels.append(rank)
        else:
            levels = []
        size = np.bincount(group, minlength=len(active))
        active = active[size[group] > 1]
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    if not levels:
        lcp = neighbour_lcp(sa, rank, words_of, stop)
        np.maximum.at(best, sa[:-1], lcp)
        np.maximum.at(best, sa[1:], lcp)
        return best
    # neighbours that share a first word; longer prefixes level by level
    pair = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    a, b = sa[:-1][pair], sa[1:][pair]
    lcp = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        inside = (x < stop[a]) & (y < stop[b])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        # a shared rank of level k is 2^k equal words unless the document ends sooner
        lcp[same] += 1 << k
    np.maximum.at(best, a, lcp)
    np.maximum.at(best, b, lcp)
    return best


def neighbour_lcp(sa: np.ndarray, rank: np.ndarray, word: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Words that each two neighbours of the suffix array share, in text order."""
    n = len(sa)
    out = np.zeros(n - 1, np.int64)
    at, order, w, end, to = (memoryview(np.ascontiguousarray(x)) for x in (sa, rank, word, stop, out))
    h, last = 0, -1
    for i in range(n):
        if end[i] != last:                    # another document
            h, last = 0, end[i]
        r = order[i]
        if r == 0:
            h = 0
            continue
        j = at[r - 1]
        most = min(end[i] - i, end[j] - j)
        while h < most and w[i + h] == w[j + h]:
            h += 1
        to[r - 1] = h
        h = max(h - 1, 0)
    return out


def measure(arr: pa.Array, min_words: int = MIN_WORDS) -> pa.Array:
    """Counts and repeated spans of each text (null: no words)."""
    data, offs = utf8(arr)
    word = NON_SPACE[data]
    s, e, bounds = runs(word, offs)
    n = len(s)
    h = SpanHash(data)
    words = h.spans(s, e)
    n_words = np.diff(bounds)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    stop = np.repeat(bounds[1:], n_words)

    tri = window_hash(words, 3)
    ok = np.flatnonzero(window_ok(bounds, n, 3))
    twice = ok[repeated(mix(tri[ok] ^ (doc[ok].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))))]
    in_tri = cover(n, twice, 3)

    ls, le, lb = runs(data != 0x0A, offs)
    has_word = np.searchsorted(s, ls) < np.searchsorted(s, le)
    ls, le = ls[has_word], le[has_word]
    ldoc = np.searchsorted(offs, ls, side="right") - 1
    lkey = mix(h.spans(ls, le) ^ (ldoc.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)))
    _, first = np.unique(lkey, return_index=True)
    dup = np.bincount(ldoc, minlength=len(n_words)) - np.bincount(ldoc[first], minlength=len(n_words))

    longest = suffix_repeats(words, doc, stop)
    at = np.flatnonzero(longest >= min_words)
    covered = np.zeros(n, bool)
    end = at + longest[at]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, end, -1)
    covered = np.cumsum(step[:n]) > 0
    top = np.zeros(len(n_words), np.int64)
    np.maximum.at(top, doc, longest)
    rs, re_, rb = runs(covered, bounds)
    span = pa.StructArray.from_arrays(
        [pa.array(rs - np.repeat(bounds[:-1], np.diff(rb)), pa.int32()),
         pa.array(re_ - np.repeat(bounds[:-1], np.diff(rb)), pa.int32())], names=["start", "stop"])
    code_points = word & ((data & 0xC0) != 0x80)
    return struct_array(_FIELDS, n_words=n_words, word_chars=per_doc(code_points, offs),
                        n_symbols=per_doc(_SYMBOLS[data], offs), n_dup_lines=dup,
                        n_repeat_words=per_doc(in_tri, bounds), n_covered=per_doc(covered, bounds),
                        longest_repeat=top,
                        repeats=pa.ListArray.from_arrays(pa.array(rb, pa.int32()), span))


def repetition(docs: DataFrame, text_col: str = "text", out: str = "repetition",
               min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with a struct column ``out`` of counts and repeated spans (in word
    positions); an existing column of that name is replaced.  Null and empty
    texts have no words, symbols, lines or repeats."""
    def make():
        return lambda arr: measure(arr, min_words)
    return docs.withColumn(out, block_udf(f"struct<{RESULT}>", make)(F.col(text_col)))


def verdict(r: str, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT):
    """False if repeats cover more than ``max_covered`` of the words or the
    longest repeat has more than ``max_repeat`` words."""
    return ((F.col(f"{r}.n_covered") <= max_covered * F.col(f"{r}.n_words"))
            & (F.col(f"{r}.longest_repeat") <= max_repeat))


def base_failed(r: str):
    return ((F.col(f"{r}.n_words") < BASE_MIN_WORDS)
            | (F.col(f"{r}.n_repeat_words") > BASE_MAX_REPEAT * F.col(f"{r}.n_words")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, base_failed, kept (no base rule failed and the
    repetition verdict holds), n_covered and longest_repeat.  Null ids and
    repeated rows stay rows of their own."""
    d = repetition(only(docs, doc_id=id_col, text=text_col), "text", "r")
    return d.select("doc_id", "r.n_words", "r.word_chars", "r.n_symbols", "r.n_dup_lines",
                    "r.n_repeat_words", base_failed("r").alias("base_failed"),
                    (~base_failed("r") & verdict("r")).alias("kept"),
                    "r.n_covered", "r.longest_repeat")


def sql(documents: str = "documents") -> str:
    """DuckDB SQL for ``report`` without longest_repeat: words in repeats of
    MIN_WORDS or more are the words in MIN_WORDS-word windows found twice, and a
    repeat above MAX_REPEAT is a window of MAX_REPEAT + 1 words found twice."""
    def twice(k: int) -> str:
        return f"""
w{k} AS (SELECT r, i, array_to_string(w[i:i + {k - 1}], ' ') AS x
        FROM (SELECT r, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM d WHERE len(w) >= {k})),
t{k} AS (SELECT w{k}.r, i FROM w{k} JOIN (SELECT r, x FROM w{k} GROUP BY r, x HAVING count(*) > 1) USING (r, x)),
c{k} AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {k})) AS p FROM t{k}) GROUP BY r)"""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {documents}),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n
          FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),{twice(3)},{twice(MIN_WORDS)},{twice(MAX_REPEAT + 1)},
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(lines.n, 0) AS n_dup_lines, coalesce(c3.n, 0) AS n_repeat_words,
             coalesce(c{MIN_WORDS}.n, 0) AS n_covered, coalesce(c{MAX_REPEAT + 1}.n, 0) > 0 AS too_long
      FROM d LEFT JOIN lines USING (r) LEFT JOIN c3 USING (r) LEFT JOIN c{MIN_WORDS} USING (r)
             LEFT JOIN c{MAX_REPEAT + 1} USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)
         AND n_covered <= {MAX_COVERED} * n_words AND NOT too_long AS kept,
       CAST(n_covered AS BIGINT) AS n_covered
FROM m"""
