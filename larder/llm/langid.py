"""Language identification (6): interpolated Kneser-Ney character models.

A text is its letters (lower-cased code points) with one space for each run of
anything else.  Each language has an alphabet of its own: its 62 most frequent
letters are a symbol each, the rest share one symbol, within which a letter has
its smoothed share of what the language's documents show.  The counts of
4-symbol windows over all learning documents give a Kneser-Ney model per
language: sorted arrays of window keys with their probabilities, and of
contexts with their back-off weights.  A text's cross-entropy per character is
compared between the languages; the lowest wins.  A text whose best
cross-entropy lies above what all but a stated share of its language's
learning documents show is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.text import (block_ranges, block_udf, only, per_doc, remainder, struct_array)
from larder.operators.windows import running_total
from larder.session import cut_lineage, stored

ORDER = 4                 # symbols in a window: at most 64^4 distinct windows per language
BITS = 6
SPACE, OTHER = 0, 63      # symbols 1..62 are the most frequent letters of a language
MODULUS, HELD_OUT = 4, 2
FALSE_REJECT = 0.005      # share of a language's own documents that its limit rejects

RESULT = "lang:string,score:double,entropy:double,rejected:boolean"
_FIELDS = {"lang": pa.string(), "score": pa.float64(), "entropy": pa.float64(), "rejected": pa.bool_()}


def letter_table() -> np.ndarray:
    """Code point -> is it a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def characters(texts: list[str | None], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all lower-cased letters, with one 0 after each run of them that
    something else follows, their bounds per text, and whether a text has a letter."""
    low = [(t or "").lower() for t in texts]
    point = np.frombuffer(("".join(low)).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, low), np.int64, len(low))
    doc = np.repeat(np.arange(len(low)), size)
    is_letter = letter[point]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] & (doc[1:] == doc[:-1])
    point, doc = np.where(is_letter, point, 0)[keep], doc[keep]
    bounds = np.searchsorted(doc, np.arange(len(low) + 1))
    return point, bounds, per_doc(point != 0, bounds) > 0


def windows(point: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct code points (0 first), the distinct windows of ORDER characters as
    indexes into them ([ORDER, window], last character first; zeros before a text),
    and the window that ends at each character."""
    seen = np.zeros(0x110000, bool)
    seen[point] = True
    seen[0] = True
    codes = np.flatnonzero(seen)
    rank = np.zeros(0x110000, np.int64)
    rank[codes] = np.arange(len(codes))
    cols = np.zeros((ORDER, len(point)), np.int64)
    cols[0] = rank[point]
    pos = np.arange(len(point)) - np.repeat(bounds[:-1], np.diff(bounds))
    for j in range(1, ORDER):
        cols[j, j:] = cols[0, :-j]
        cols[j, pos < j] = 0
    bits = max(1, int(len(codes) - 1).bit_length())
    last, before = cols[0] | cols[1] << bits, cols[2] | cols[3] << bits
    if 4 * bits > 62:                                  # too many letters for one key: number the pairs
        last, before = (np.unique(x, return_inverse=True)[1] for x in (last, before))
        bits = 16
    distinct, at = np.unique(last | before << 2 * bits, return_inverse=True)
    one = np.zeros(len(distinct), np.int64)
    one[at] = np.arange(len(at))
    return codes, cols[:, one], at


def alphabet(point: np.ndarray, n: np.ndarray, letters: int) -> dict[str, np.ndarray]:
    """Sorted letters of a language with their symbols and, for letters that share a
    symbol, the log-probability within it (half a count more for each of the
    ``letters`` there are); ``unseen`` is that of a letter never seen."""
    order = np.lexsort((point, -n))
    symbol, price = np.full(len(point), OTHER, np.int64), np.zeros(len(point))
    symbol[order[:OTHER - 1]] = np.arange(1, 1 + min(len(order), OTHER - 1))
    rest = order[OTHER - 1:]
    total = n[rest].sum() + 0.5 * max(1, letters - min(len(order), OTHER - 1))
    price[rest] = np.log((n[rest] + 0.5) / total)
    o = np.argsort(point)
    return {"point": point[o], "symbol": symbol[o], "price": price[o], "unseen": np.log(0.5 / total)}


def translate(codes: np.ndarray, letters: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and log-probability within the symbol of each code point (the first is
    the space)."""
    at = _find(letters["point"], codes)
    symbol = np.where(at >= 0, letters["symbol"][at], OTHER)
    price = np.where(at >= 0, letters["price"][at], letters["unseen"])
    symbol[0], price[0] = SPACE, 0.0
    return symbol, price


def packed(symbol: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Keys of windows: the last symbol in the lowest bits."""
    key = np.zeros(cols.shape[1], np.int64)
    for j in range(ORDER):
        key |= symbol[cols[j]] << (BITS * j)
    return key


def _add(total: dict, name: str, key: np.ndarray, n: np.ndarray) -> None:
    if name in total:
        key, n = np.concatenate([total[name][0], key]), np.concatenate([total[name][1], n])
    key, at = np.unique(key, return_inverse=True)
    total[name] = (key, np.bincount(at, weights=n, minlength=len(key)).astype(np.int64))


def _per_language(docs: DataFrame, count, field: str) -> DataFrame:
    """(lang, ``field``, n) over all rows: ``count`` gives a block's (lang, keys, counts);
    each task adds them up before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letter_table()
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            text = b.column(0).cast(pa.large_string())
            lang = b.column(1).to_pylist()
            for lo, hi in block_ranges(text):
                point, bounds, _ = characters(text.slice(lo, hi - lo).to_pylist(), letter)
                names, of = np.unique(np.array(lang[lo:hi], object).astype(str), return_inverse=True)
                for name, key, n in count(point, bounds, names.tolist(), np.repeat(of, np.diff(bounds))):
                    _add(total, name, key, n)
        for name, (k, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k, pa.int64()),
                                              pa.array(n, pa.int64())], names=["lang", field, "n"])
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), "lang")
    return rows.mapInArrow(run, f"lang string, {field} long, n long").groupBy("lang", field).agg(F.sum("n").alias("n"))


def letter_counts(docs: DataFrame) -> DataFrame:
    """(lang, point, n): how often each letter stands in the texts of each language."""
    def count(point, bounds, names, which):
        for i, name in enumerate(names):
            n = np.bincount(point[which == i], minlength=1)
            n[0] = 0
            seen = np.flatnonzero(n)
            yield name, seen, n[seen]
    return _per_language(docs, count, "point")


def window_counts(docs: DataFrame, alphabets: dict[str, dict]) -> DataFrame:
    """(lang, key, n): how often each window of a language's symbols stands in its texts."""
    held = docs.sparkSession.sparkContext.broadcast(alphabets)

    def count(point, bounds, names, which):
        codes, cols, at = windows(point, bounds)
        for i, name in enumerate(names):
            if name in held.value:
                n = np.bincount(at[which == i], minlength=cols.shape[1])
                seen = np.flatnonzero(n)
                yield name, packed(translate(codes, held.value[name])[0], cols[:, seen]), n[seen]
    return _per_language(docs, count, "key")


def kneser_ney(key: np.ndarray, n: np.ndarray) -> dict[str, list]:
    """Sorted arrays per order: windows with probabilities (interpolated with all
    lower orders), contexts with back-off weights.

    The highest order uses counts, the lower ones the number of distinct symbols
    seen before the window; one discount per order from the counts of
    once- and twice-seen windows.
    """
    grams, counts = [], []
    for order in range(ORDER, 0, -1):
        o = np.argsort(key)
        grams.append(key[o])
        counts.append(n[o].astype(np.float64))
        tail = key & ((1 << BITS * (order - 1)) - 1)
        key, n = np.unique(tail, return_counts=True)
    out: dict[str, list] = {"keys": [], "probs": [], "contexts": [], "backoff": []}
    below_keys, below = np.arange(1 << BITS), np.full(1 << BITS, 1.0 / (1 << BITS))
    for order in range(1, ORDER + 1):
        k, c = grams[ORDER - order], counts[ORDER - order]
        ones, twos = (c == 1).sum(), (c == 2).sum()
        discount = min(0.95, max(0.1, ones / max(1.0, ones + 2.0 * twos)))
        ctx, at = np.unique(k >> BITS, return_inverse=True)
        total = np.bincount(at, weights=c)
        weight = discount * np.bincount(at) / total
        tail = k & ((1 << BITS * max(order - 1, 1)) - 1)
        low = below[np.searchsorted(below_keys, tail)]
        p = (c - discount) / total[at] + weight[at] * low
        out["keys"].append(k)
        out["probs"].append(p)
        out["contexts"].append(ctx)
        out["backoff"].append(weight)
        below_keys, below = k, p
    return out


def _find(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, key)
    at[at == len(keys)] = 0
    return np.where(keys[at] == key, at, -1) if len(keys) else np.full(len(key), -1)


@dataclass
class Model:
    langs: list[str]
    tables: list[dict]
    limits: np.ndarray      # per language: accepted cross-entropy
    alphabets: list[dict] = field(default_factory=list)

    def log_prob(self, key: np.ndarray) -> np.ndarray:
        """Natural log-probability of each window's last symbol: [language, window];
        the keys may differ between the languages ([language, window])."""
        key = np.broadcast_to(key, (len(self.langs), np.shape(key)[-1]))
        out = np.empty(key.shape)
        for i, t in enumerate(self.tables):
            p = np.full(key.shape[1], 1.0 / (1 << BITS))
            for order in range(1, ORDER + 1):
                part = key[i] & ((1 << BITS * order) - 1)
                ctx = _find(t["contexts"][order - 1], part >> BITS)
                p = np.where(ctx >= 0, t["backoff"][order - 1][ctx] * p, p)
                at = _find(t["keys"][order - 1], part)
                p = np.where(at >= 0, t["probs"][order - 1][at], p)
            out[i] = np.log(p)
        return out

    def entropies(self, texts: list, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character [language, text], characters and has-a-letter per text."""
        point, bounds, letters = characters(texts, letter)
        n = np.diff(bounds)
        if not self.langs:
            return np.zeros((0, len(n))), n, letters
        codes, cols, at = windows(point, bounds)
        known = [translate(codes, a) for a in self.alphabets]
        logs = self.log_prob(np.stack([packed(symbol, cols) for symbol, _ in known]))
        h = [-per_doc((row + price[cols[0]])[at], bounds) / np.maximum(n, 1) for row, (_, price) in zip(logs, known)]
        return np.stack(h), n, letters

    def column(self, arr: pa.Array, letter: np.ndarray) -> pa.Array:
        h, n, letters = self.entropies(arr.to_pylist(), letter)
        ok = letters & (len(self.langs) > 0)
        if not len(h):
            h = np.zeros((1, len(n)))
        best = h.argmin(axis=0)
        low = h.min(axis=0)
        # posterior of the winner over the symbols of the text, equal priors; long texts saturate
        gap = np.exp(np.clip(-(h - low) * np.minimum(n, 400), -700, 0)).sum(axis=0)
        limit = self.limits[best] if len(self.langs) else np.zeros(len(n))
        names = np.array(self.langs or ["und"], object)
        return struct_array(_FIELDS, lang=[str(x) if k else "und" for x, k in zip(names[best], ok)],
                            score=np.where(ok, 1 / gap, 0.0), entropy=np.where(ok, low, 0.0),
                            rejected=~ok | (low > limit))


def learning(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, text, lang) of the documents that models and limits are learned from."""
    return only(docs, id=id_col, text=text_col, lang=lang_col).filter("id is not null and lang is not null").filter(
        remainder("id", MODULUS) != HELD_OUT)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Models of all languages of the documents that are not held out (crc32(id) mod 4
    is not 2) and have a language and an id.  Window counts and limits use every such
    document; a table has at most 64^4 windows and an alphabet of all letters there
    are per language whatever the input.  The rejection limit of a language is
    the cross-entropy that a share of FALSE_REJECT of its documents exceeds.
    """
    d = learning(docs, id_col, text_col, lang_col)
    model = fit_windows(d)
    own = stored(score(d, model, "text", "l").filter("l.lang = lang").select("lang", "l.entropy"), "entropies")
    model.limits += limits(own, model.langs)
    return model


def fit_windows(d: DataFrame) -> Model:
    """The model of ``learning`` documents, its limits still 0."""
    point = cut_lineage(letter_counts(d)).toArrow()
    lang = np.array(point.column("lang").to_pylist(), object)
    langs = sorted(set(lang.tolist()))
    model = Model(langs, [], np.zeros(len(langs)))
    if not langs:
        return model
    letters = int(letter_table().sum())
    for x in langs:
        rows = point.filter(pa.array(lang == x))
        model.alphabets.append(alphabet(rows.column("point").to_numpy(), rows.column("n").to_numpy(), letters))
    counts = cut_lineage(window_counts(d, dict(zip(langs, model.alphabets)))).toArrow()
    lang = np.array(counts.column("lang").to_pylist(), object)
    key, n = counts.column("key").to_numpy(), counts.column("n").to_numpy()
    model.tables += [kneser_ney(key[lang == x], n[lang == x]) for x in langs]
    return model


def limits(own: DataFrame, langs: list[str]) -> np.ndarray:
    """Per language the entropy that a share of FALSE_REJECT of its rows in ``own`` (lang, entropy)
    exceeds, between the two nearest as SQL's percentile; infinite without a row.  Equal entropies are
    one row with their number, and ranks come from running sums in chunks of the entropy, so
    no task gets a language whole."""
    values = own.groupBy("lang", "entropy").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_total(values, "lang", ["entropy"], "n", F.floor(F.col("entropy") * 1024), out="upto")
    size = own.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    at = (F.col("size") - 1) * F.lit(1 - FALSE_REJECT)
    near = ranked.join(size, "lang").filter((F.col("upto") > F.floor(at)) & (F.col("upto") - F.col("n") <= F.ceil(at)))
    out = np.full(len(langs), np.inf)
    ends: dict[str, list] = {}
    for r in near.select("lang", "entropy", at.alias("at")).collect():
        ends.setdefault(r.lang, [r.at, []])[1].append(r.entropy)
    for lang, (rank, found) in ends.items():
        lo, hi = min(found), max(found)
        out[langs.index(lang)] = lo if lo == hi else (np.ceil(rank) - rank) * lo + (rank - np.floor(rank)) * hi
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: lang (``und`` for null texts and texts
    without a letter, also when nothing was learned), score (0 to 1), entropy
    (nats per character) and rejected."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))

    def make():
        m, letter = Model(**held.value), letter_table()
        return lambda arr: m.column(arr, letter)
    return docs.withColumn(out, block_udf(f"struct<{RESULT}>", make)(F.col(text_col)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected.  Null ids are not
    held out and not learned from; repeated rows stay.  Every text is scored once; the limits
    come from the scores of the learning documents."""
    model = fit_windows(learning(docs, id_col, text_col, lang_col))
    d = score(only(docs, doc_id=id_col, text=text_col, lang=lang_col), model)
    d = stored(d.select("doc_id", "lang", F.coalesce(remainder("doc_id", MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"),
                        F.col("language.lang").alias("lang_pred"), "language.score", "language.entropy"), "languages")
    own = d.filter("doc_id is not null and not held_out and lang_pred = lang").select("lang", "entropy")
    limit = zip(model.langs, limits(own, model.langs).tolist())
    most = F.create_map(*[F.lit(x) for pair in limit for x in pair])[F.col("lang_pred")] if model.langs else F.lit(0.0)
    # a score of 0: no letter, or nothing learned
    return d.select("doc_id", "held_out", "lang_pred", "score",
                    ((F.col("score") == 0) | F.coalesce(F.col("entropy") > most, F.lit(False))).alias("rejected"))
