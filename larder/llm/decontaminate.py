"""Benchmark decontamination (2).

The windows of the benchmark (``window`` consecutive normalised words, or a
shorter item's whole word sequence) form a hash set that is broadcast when it
is below a size limit; training texts are scanned block by block, every hash
hit is verified on the words themselves, and the hit words are merged to spans.
Beyond the limit the windows are scanned in several passes (see ``scan``), each with a broadcast
part below the limit, so the result is the same at every benchmark size.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.text import (LOWER, WORD_CHARS, SpanHash, block_udf, only, runs,
                             struct_array, utf8, window_hash, window_ok)

WINDOW = 10
MAX_WINDOWS = 1_000_000     # windows in one broadcast set: about 100 MB at 100 bytes each

# normalised words as SQL: lower-case A-Z only, then the contract's word pattern
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

RESULT = "n_words long, hits array<struct<start:int,stop:int,items:array<string>>>"
_HIT = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()),
                           ("items", pa.list_(pa.string()))]))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """Distinct (words, items): each window's words joined by spaces, with the
    sorted ids (as strings) of the items that hold it.

    Items without a word (null, empty, only separators) have no window.  An item
    with a null id has windows like any other (they hit and are removed); only its id is in no
    list.  Repeated items fold into one.
    """
    b = only(benchmark, item=F.col(id_col).cast("string"), text=text_col)
    words = b.select("item", F.regexp_extract_all(
        F.translate("text", _UPPER, _LOWER), F.lit(_WORD), F.lit(0)).alias("w")).filter("size(w) > 0")
    at = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    one = words.select("item", "w", F.explode(at).alias("at")).select(
        "item", F.array_join(F.slice("w", F.col("at") + 1, window), " ").alias("words"))
    return one.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class _Set:
    """The broadcast window set: per window length, sorted hashes with their words."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        self.items: list[list[str]] = [items for _, items in rows]
        self.by_len: list[tuple[int, np.ndarray, list, np.ndarray]] = []
        by: dict[int, list[int]] = {}
        for i, (w, _) in enumerate(rows):
            by.setdefault(w.count(" ") + 1, []).append(i)
        for k, ids in sorted(by.items()):
            text = [rows[i][0].encode() for i in ids]
            data, offs = utf8(pa.array([rows[i][0] for i in ids], pa.large_string()))
            s, e, bounds = runs(data != 0x20, offs)
            h = window_hash(SpanHash(data).spans(s, e), k)[bounds[:-1]]
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[h >> np.uint64(42)] = True
            self.by_len.append((k, h[order], [(text[j], ids[j]) for j in order], bits))

    def scan(self, arr: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """Per hit (document, first word, number of words, window id), the words
        per document and the documents' word bounds."""
        data, offs = utf8(arr)
        data = LOWER[data]
        s, e, bounds = runs(WORD_CHARS[data], offs)
        words = SpanHash(data).spans(s, e)
        hits = []
        for k, known, texts, bits in self.by_len:
            h = window_hash(words, k)
            maybe = np.flatnonzero(bits[h >> np.uint64(42)])
            maybe = maybe[window_ok(bounds, len(words), k)[maybe]]
            first = np.searchsorted(known, h[maybe])
            ok = (first < len(known))
            ok[ok] = known[first[ok]] == h[maybe][ok]
            docs = np.searchsorted(bounds, maybe, side="right") - 1
            for i, j, d in zip(maybe[ok].tolist(), first[ok].tolist(), docs[ok].tolist()):
                found = b" ".join(data[a:b].tobytes() for a, b in zip(s[i:i + k], e[i:i + k]))
                while j < len(known) and known[j] == h[i]:    # equal hashes: the words decide
                    if texts[j][0] == found:
                        hits.append((d, i, k, texts[j][1]))
                    j += 1
        return hits, np.diff(bounds), bounds

    def column(self, arr: pa.Array) -> pa.Array:
        hits, n_words, bounds = self.scan(arr)
        rows: list[list] = [[] for _ in range(len(arr))]
        for d, i, k, w in hits:
            i -= int(bounds[d])
            rows[d].append({"start": i, "stop": i + k, "items": self.items[w]})
        return struct_array({"n_words": pa.int64(), "hits": _HIT}, n_words=n_words, hits=rows)


def scan(docs: DataFrame, windows: DataFrame, text_col: str = "text", out: str = "hits",
         max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with one struct column ``out``: the number of words and each
    verified occurrence of a window as (start, stop, items) in word positions.

    The set is counted first.  Up to ``max_windows`` it is one broadcast; a
    larger one is cut by word hash into parts below the limit, one pass over
    the texts per part, and the hits are put together: a stated query set
    against all rows, in blocks.  Null and empty texts have no words and no
    hits.  An existing column named ``out`` is replaced.
    """
    spark = docs.sparkSession
    n = windows.count()
    parts = max(1, -(-n // max_windows)) if n <= max_windows else 2 * -(-n // max_windows)
    names, run = [], uuid.uuid4().hex          # names that no column of the input has
    for p in range(parts):
        part = windows if parts == 1 else windows.filter(F.pmod(F.xxhash64("words"), F.lit(parts)) == p)
        held = spark.sparkContext.broadcast([(r.words, r["items"]) for r in part.collect()])

        def make(held=held):
            known = _Set(held.value)
            return known.column
        names.append(f"hits_{run}_{p}")
        docs = docs.withColumn(names[-1], block_udf(f"struct<{_ddl(RESULT)}>", make)(F.col(text_col)))
    whole = F.struct(F.col(f"{names[0]}.n_words").alias("n_words"),
                     F.concat(*[F.col(f"{c}.hits") for c in names]).alias("hits"))
    return docs.withColumn(out, whole).drop(*names)


def _ddl(fields: str) -> str:
    return fields.replace("n_words long", "n_words:bigint").replace("hits array", "hits:array")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_hit (words inside a window), n_items,
    items_sha256 (of the sorted item ids, comma-joined), contaminated.

    Null ids and repeated rows stay as rows of their own; extra columns of the
    inputs are not looked at.  Empty tables give an empty report, and an empty
    benchmark hits nothing.
    """
    d = only(docs, doc_id=id_col, text=text_col)
    hit = scan(d, benchmark_windows(benchmark, window))
    return hit.select("doc_id", "hits.n_words", _n_hit("hits.hits").alias("n_hit"),
                      _items("hits.hits").alias("items")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def _items(hits: str):
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["items"]))))


def _n_hit(hits: str):
    at = F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["stop"] - 1)))
    return F.size(F.array_distinct(at)).cast("long")


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                     text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold any benchmark window; columns as they were."""
    tag = f"contamination_{uuid.uuid4().hex}"
    return scan(docs, benchmark_windows(benchmark, window), text_col, tag).filter(
        F.size(f"{tag}.hits") == 0).drop(tag)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                 text_col: str = "text") -> DataFrame:
    """``docs`` with the hit words (first to last word of each merged span, and
    what lies between) cut from the text; other texts and columns unchanged."""
    @F.arrow_udf("string")
    def cut(text: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for t, row in zip(text.to_pylist(), hits.to_pylist()):
            if t is not None and row:
                data = t.encode()
                raw, offs = utf8(pa.array([t], pa.large_string()))
                s, e, _ = runs(WORD_CHARS[LOWER[raw]], offs)
                hit = np.zeros(len(s), bool)
                for h in row:
                    hit[h["start"]:h["stop"]] = True
                first, last, _ = runs(hit, np.array([0, len(hit)]))
                keep, at = [], 0
                for a, b in zip(first, last):
                    keep.append(data[at:s[a]])
                    at = e[b - 1]
                t = (b"".join(keep) + data[at:]).decode()
            out.append(t)
        return pa.array(out, pa.string())
    tag = f"contamination_{uuid.uuid4().hex}"
    return scan(docs, benchmark_windows(benchmark, window), text_col, tag).withColumn(
        text_col, F.when(F.size(f"{tag}.hits") == 0, F.col(text_col)).otherwise(
            cut(F.col(text_col), F.col(f"{tag}.hits")))).drop(tag)


def sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """DuckDB SQL for ``report``."""
    def words(col: str) -> str:
        return (f"regexp_extract_all(translate({col}, '{_UPPER}', '{_LOWER}'), "
                rf"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS w FROM {documents}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words("text")} AS w FROM {benchmark}),
bw AS (SELECT DISTINCT item, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS x, least(len(w), {WINDOW}) AS k
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS x
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.r, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.x = bw.x AND dw.k = bw.k),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""
