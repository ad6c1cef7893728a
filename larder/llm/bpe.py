"""BPE encoding and decoding (1) by a pair occurrence index.

The distinct pre-tokens of a block of texts are laid out as one array of
symbols with links to the next and the previous symbol of the same word.  An
index maps each mergeable pair to all its positions; active ranks are taken in
ascending order from a heap, all positions of the pair are merged at once, and
the pairs to the left and right of each merge enter the index.  Words are
encoded once per block, whatever their number of occurrences.

Encoded ids travel as one binary value per document (little-endian unsigned
32-bit integers), which ``unpack`` turns into an array column.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.text import batch_udf, block_udf, only

ENCODE_BLOCK = 4 << 20      # texts that share one pair index
KEEP_WORDS = 150_000         # encoded words a task keeps from block to block


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte:
    printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    out = {b: chr(b) for b in keep} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class Vocabulary:
    """A word-level BPE vocabulary file: merges, specials, normaliser and split."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + end] for c in chars], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.left, self.right, self.made = left, right, made
        key = left << 32 | right
        self.order = np.argsort(key)
        self.keys = key[self.order]
        # a rank whose product takes part in a lower rank: its merges go one at a
        # time per word, as a merge may then change what a later position holds
        lowest = np.full(len(self.tokens), len(pairs), np.int64)
        np.minimum.at(lowest, left, np.arange(len(pairs)))
        np.minimum.at(lowest, right, np.arange(len(pairs)))
        self.single = lowest[made] <= np.arange(len(pairs))
        split = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"][0]
        self.pattern = split["pattern"]["Regex"]
        self.special_pattern = "|".join(map(regex.escape, self.special))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 if the pair never merges."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], -1)


def encode_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words (non-empty byte strings), and each word's offset in them."""
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    size = np.fromiter(map(len, words), np.int64, len(words))
    offs = np.concatenate([[0], np.cumsum(size)])
    sym = v.inner[data]
    sym[offs[1:] - 1] = v.final[data[offs[1:] - 1]]
    nxt = np.arange(1, n + 1)
    nxt[offs[1:] - 1] = -1
    prv = np.arange(-1, n - 1)
    prv[offs[:-1]] = -1
    alive = np.ones(n, bool)
    word = np.repeat(np.arange(len(words)), size) if v.single.any() else None
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        r = v.ranks(sym[at], sym[nxt[at]])
        at, r = at[r >= 0], r[r >= 0]
        if not len(at):
            return
        o = np.argsort(r, kind="stable")
        at, r = at[o], r[o]
        cut = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1, [len(r)]]).tolist()
        for x, y in zip(cut[:-1], cut[1:]):
            rank = int(r[x])
            if rank not in index:
                index[rank] = []
                heapq.heappush(heap, rank)
            index[rank].append(at[x:y])

    enter(np.flatnonzero(nxt >= 0))
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        a, b = v.left[rank], v.right[rank]
        p = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        p = p[alive[p] & (sym[p] == a) & (nxt[p] >= 0)]
        p = p[sym[nxt[p]] == b]
        if not len(p):
            continue
        if a == b:                                   # a run of equal symbols merges from its left
            p = np.sort(p)
            chained = np.concatenate([[False], nxt[p[:-1]] == p[1:]])
            start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(p))))
            p = p[(np.arange(len(p)) - start) % 2 == 0]
        if v.single[rank]:
            p = np.sort(p)
            first = np.concatenate([[True], word[p][1:] != word[p][:-1]])
            if not first.all():
                index[rank] = [p[~first]]
                heapq.heappush(heap, rank)
                p = p[first]
        q = nxt[p]
        sym[p] = v.made[rank]
        alive[q] = False
        after = nxt[q]
        nxt[p] = after
        has = after >= 0
        prv[after[has]] = p[has]
        before = prv[p]
        enter(np.unique(np.concatenate([before[before >= 0], p[has]])))
    counts = np.add.reduceat(alive, offs[:-1], dtype=np.int64) if len(words) else np.zeros(0, np.int64)
    return sym[alive], np.concatenate([[0], np.cumsum(counts)])


class Encoder:
    """Encodes blocks of texts; keeps the words it has met up to a bound."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.split = regex.compile(v.pattern).findall
        self.special = regex.compile(f"({v.special_pattern})") if v.special else None
        self._clear()

    def _clear(self) -> None:
        # the first entries are the special tokens, whose text is never a word
        self.known: dict[str, int] = {}
        self.ids = [np.array(list(self.v.special.values()), np.int32)]
        self.offs = [np.arange(len(self.v.special) + 1, dtype=np.int64)]
        self.n = len(self.v.special)

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")   # lower-cased char by char
        return self.split(text.lower())

    def _indices(self, text: str, fresh: list[str]) -> list[int]:
        known, base, out = self.known, self.n, []
        parts = self.special.split(text) if self.special and "<|" in text else [text]
        for i, part in enumerate(parts):
            if i % 2:
                out.append(list(self.v.special).index(part))
                continue
            for w in self._words(part):
                k = known.get(w)
                if k is None:
                    k = known[w] = base + len(fresh)
                    fresh.append(w)
                out.append(k)
        return out

    def __call__(self, arr: pa.Array) -> pa.Array:
        if len(self.known) > KEEP_WORDS:
            self._clear()
        fresh: list[str] = []
        docs = [np.array(self._indices(t, fresh) if t else [], np.int32) for t in arr.to_pylist()]
        if fresh:
            ids, offs = encode_words(self.v, [w.encode() for w in fresh])
            self.ids = [np.concatenate([*self.ids, ids])]
            self.offs = [np.concatenate([self.offs[0], self.offs[0][-1] + offs[1:]])]
            self.n += len(fresh)
        ids, offs = self.ids[0], self.offs[0]
        size, out = np.diff(offs), []
        for d in docs:
            m = size[d]
            to = np.cumsum(m)
            total = int(to[-1]) if len(to) else 0
            at = np.arange(total) + np.repeat(offs[:-1][d] - (to - m), m)
            out.append(ids[at].astype("<u4").tobytes())
        return pa.array(out, pa.binary())


def load(path: str) -> str:
    """The text of a vocabulary file (read on the driver; a fixed file of a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a binary column ``out`` of packed ids; ``vocabulary`` is the
    text of the file.  Null and empty texts give zero ids.  An existing column
    named ``out`` is replaced; all other columns and repeated rows stay."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        return Encoder(Vocabulary(held.value))
    return docs.withColumn(out, block_udf("binary", make, ENCODE_BLOCK)(F.col(text_col)))


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the decoded text of packed ids: the vocabulary's strings,
    specials included, joined by spaces (the file names no decoder).  Null ids
    decode to null."""
    held = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        strings = pa.array(Vocabulary(held.value).tokens, pa.string())

        def text(ids: pa.Array) -> pa.Array:
            raw = [b"" if x is None else x for x in ids.to_pylist()]
            flat = strings.take(pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int64)))
            offs = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])])
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offs, pa.int32()), flat), " ")
            return pc.if_else(ids.is_null(), None, joined)
        return text
    return tokens.withColumn(out, batch_udf("string", make)(F.col(ids_col)))


def n_tokens(ids: str = "ids"):
    return (F.octet_length(F.col(ids)) / 4).cast("long")


def unpack(ids: str = "ids"):
    """Packed ids as an array of long."""
    @F.arrow_udf("array<bigint>")
    def arrays(x: pa.Array) -> pa.Array:
        return pa.array([None if b is None else np.frombuffer(b, "<u4").astype(np.int64) for b in x.to_pylist()],
                        pa.list_(pa.int64()))
    return arrays(F.col(ids))


def report(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, SHA-256 of the packed ids, SHA-256 of
    the decoded text.  Null ids and repeated rows stay rows of their own."""
    d = encode(only(docs, doc_id=id_col, text=text_col), vocabulary).select("doc_id", "ids")
    d = decode(d, vocabulary)
    return d.select("doc_id", n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
