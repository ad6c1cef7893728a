"""License scans by template-markup matching (11).

A template's markup is compiled into an automaton over words: mandatory words,
optional regions that may be stepped over, replaceable regions of a bounded
number of any words.  The automaton is run from every place of a text where its
first two words can stand, and accepts where the mandatory wording matches
exactly; its subset states are built as texts ask for them and kept for the
task.  Phrases are counted beside it as the base.

Everything happens inside the scan of the documents: nothing is shuffled, and the
automata are a few hundred words.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.license_templates import TEMPLATES
from larder.llm.text import LOWER, WORD_CHARS, SpanHash, block_udf, only, runs, struct_array, utf8

# fixed values of the contract: phrase, label
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
           ("mit license", "mit")]
ANY = "*"
_SIGNS = re.compile(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
           "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
           "spans": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))}
RESULT = ("n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,"
          "score:double,spans:array<struct<label:string,start:int,stop:int>>")


# ---------------------------------------------------------------- templates

def parse(markup: str) -> list:
    """Markup as a list of words, (low, high) replaceable regions and lists (optional
    regions)."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in markup)
    stack: list[list] = [[]]
    for sign in _SIGNS.findall(lowered):
        if sign == "[[":
            stack.append([])
        elif sign == "]]":
            if len(stack) == 1:
                raise ValueError("optional region closed twice")
            region = stack.pop()
            stack[-1].append(region)
        elif sign.startswith("{{"):
            low, high = map(int, sign.strip("{}").split("-"))
            stack[-1].append((low, high))
        else:
            stack[-1].append(sign)
    if len(stack) > 1:
        raise ValueError("optional region left open")
    return stack[0]


class Automaton(NamedTuple):
    """Positions of a template: the word each takes, where one may begin and end, and
    what may come next."""
    label: str
    words: list[str]
    first: frozenset[int]
    last: frozenset[int]
    follow: list[frozenset[int]]

    @property
    def pairs(self) -> set[tuple[str, str]]:
        """Words that can stand at the beginning, with the next (ANY: any word)."""
        return {(self.words[p], self.words[q]) for p in self.first for q in self.follow[p]}


def compile_template(label: str, markup: str) -> Automaton:
    """Positions of the template's words; a replaceable region of a to b words is a
    positions that must and b - a that may be passed.  A template has to have a mandatory
    beginning of two words or more and to start with a word."""
    words: list[str] = []
    follow: list[set[int]] = []

    def add(word: str) -> int:
        words.append(word)
        follow.append(set())
        return len(words) - 1

    def sequence(parts: list) -> tuple[set[int], set[int], bool]:
        first: set[int] = set()
        last: set[int] = set()
        empty = True
        for part in parts:
            if isinstance(part, str):
                p = add(part)
                f, e, skip = {p}, {p}, False
            elif isinstance(part, list):
                f, e, _ = sequence(part)
                skip = True
            else:
                low, high = part
                f, e, skip = set(), set(), low == 0
                for k in range(high):
                    p = add(ANY)
                    if k == 0:
                        f = {p}
                    else:
                        follow[p - 1].add(p)
                    if k + 1 >= low:
                        e.add(p)
            for p in last:
                follow[p] |= f
            if empty:
                first |= f
            last = last | e if skip else e
            empty = empty and skip
        return first, last, empty

    first, last, empty = sequence(parse(markup))
    if empty or any(words[p] == ANY for p in first) or any(p in last for p in first):
        raise ValueError(f"template {label!r} has to start with a word and to hold two mandatory ones")
    return Automaton(label, words, frozenset(first), frozenset(last), [frozenset(f) for f in follow])


def pattern(markup: str) -> str:
    """The same template as a regular expression over ' word word ' (for SQL)."""
    def part(p) -> str:
        if isinstance(p, str):
            return f" {re.escape(p)}"
        if isinstance(p, list):
            return f"(?:{''.join(map(part, p))})?"
        return f"(?: [^ ]+){{{p[0]},{p[1]}}}"
    return "".join(map(part, parse(markup))) + " "


# ------------------------------------------------------------------ matching

class _Run:
    """An automaton with its subset states, built on demand."""

    def __init__(self, automaton: Automaton, number: dict[str, int]):
        self.a = automaton
        self.takes = [number.get(w, -1) for w in automaton.words]      # -1: any word
        self.steps: dict[tuple[frozenset[int], int], frozenset[int]] = {}
        self.accepting: dict[frozenset[int], bool] = {}

    def longest(self, ids: np.ndarray, start: int, stop: int) -> int:
        """End of the longest accepted wording that starts at ``start``, or -1."""
        state, end = None, -1
        for i in range(start, stop):
            w = int(ids[i])
            nxt = self.steps.get((state, w))
            if nxt is None:
                reach = self.a.first if state is None else frozenset().union(*[self.a.follow[p] for p in state])
                nxt = frozenset(p for p in reach if self.takes[p] == w or self.takes[p] < 0)
                self.steps[state, w] = nxt
                self.accepting[nxt] = bool(nxt & self.a.last)
            if not nxt:
                break
            if self.accepting[nxt]:
                end = i + 1
            state = nxt
        return end


class Scanner:
    """Phrases and templates over one vocabulary; made once per task."""

    def __init__(self, templates: list[tuple[str, str]] | None = None,
                 phrases: list[tuple[str, str]] | None = None):
        automata = [compile_template(*t) for t in (TEMPLATES if templates is None else templates)]
        phrases = PHRASES if phrases is None else phrases
        vocabulary = sorted({w for a in automata for w in a.words if w != ANY}
                            | {w for p, _ in phrases for w in p.split()})
        number = {w: k + 1 for k, w in enumerate(vocabulary)}          # 0: any other word
        self.spelled = [np.frombuffer(w.encode(), np.uint8) for w in vocabulary]
        ends = np.cumsum([len(w) for w in self.spelled])
        hashes = SpanHash(np.concatenate(self.spelled)).spans(ends - [len(w) for w in self.spelled], ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.phrases = [([number[w] for w in p.split()], label) for p, label in phrases]
        self.runs = [_Run(a, number) for a in automata]
        size = len(vocabulary) + 1
        self.opens = np.zeros((len(automata), size, size), bool)
        for t, a in enumerate(automata):
            for x, y in a.pairs:
                self.opens[t, number[x], slice(None) if y == ANY else number[y]] = True
        self.any_open = self.opens.any(axis=0)

    def number(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, 0 for others; equal hashes are verified by
        their letters."""
        h = SpanHash(data).spans(s, e)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        ids = np.zeros(len(s), np.int32)
        found = self.order[at[hit]]
        by = np.argsort(found, kind="stable")
        cuts = np.flatnonzero(np.diff(found[by])) + 1
        for group in np.split(by, cuts):
            if len(group):
                k = int(found[group[0]])
                w = self.spelled[k]
                rows = hit[group]
                rows = rows[e[rows] - s[rows] == len(w)]
                same = (data[s[rows][:, None] + np.arange(len(w))] == w).all(axis=1)
                ids[rows[same]] = k + 1
        return ids

    def scan(self, arr: pa.Array) -> pa.Array:
        data, offs = utf8(arr)
        data = LOWER[data]
        s, e, bounds = runs(WORD_CHARS[data], offs)
        ids = self.number(data, s, e)
        n_docs, n = len(bounds) - 1, len(s)
        doc = np.repeat(np.arange(n_docs), np.diff(bounds))
        n_base = np.zeros(n_docs, np.int64)
        first = np.full(n_docs, np.iinfo(np.int64).max)
        last = np.full(n_docs, -1, np.int64)
        base = [set() for _ in range(n_docs)]
        for words, label in self.phrases:
            k = len(words)
            if n < k:
                continue
            ok = np.ones(n - k + 1, bool)
            for j, w in enumerate(words):
                ok &= ids[j:n - k + 1 + j] == w
            at = np.flatnonzero(ok)
            at = at[doc[at] == doc[at + k - 1]]
            d = doc[at]
            n_base += np.bincount(d, minlength=n_docs)
            np.minimum.at(first, d, at - bounds[d])
            np.maximum.at(last, d, at - bounds[d])
            for x in np.unique(d):
                base[x].add(label)
        spans = [[] for _ in range(n_docs)]
        if n > 1:
            place = np.flatnonzero(self.any_open[ids[:-1], ids[1:]] & (doc[:-1] == doc[1:]))
            done = np.zeros(len(self.runs), np.int64)
            for i in place.tolist():
                d = int(doc[i])
                for t in np.flatnonzero(self.opens[:, ids[i], ids[i + 1]]).tolist():
                    if i >= done[t]:
                        end = self.runs[t].longest(ids, i, int(bounds[d + 1]))
                        if end > 0:
                            done[t] = end
                            spans[d].append((self.runs[t].a.label, i - int(bounds[d]), end - int(bounds[d])))
        labels = [",".join(sorted(b | {x[0] for x in found})) for b, found in zip(base, spans)]
        none = n_base == 0
        return struct_array(
            _FIELDS, n_words=np.diff(bounds), n_base=n_base,
            first_word=pa.array(np.where(none, 0, first), pa.int64(), mask=none),
            last_word=pa.array(np.where(none, 0, last), pa.int64(), mask=none),
            base_labels=[",".join(sorted(b)) for b in base], labels=labels,
            score=np.where([bool(x) for x in spans], 1.0, np.where(none, 0.0, 0.5)),
            spans=[[{"label": a, "start": b, "stop": c} for a, b, c in sorted(x, key=lambda y: (y[1], y[2], y[0]))]
                   for x in spans])


def scan(docs: DataFrame, text_col: str = "text", out: str = "license",
         templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``docs`` with a struct column ``out``: counts of base phrases, labels, a score
    and the spans (words from 0) of accepted templates, leftmost and longest for
    each template.  An existing column of that name is replaced.  Null and empty texts
    have no words, no places and no labels; their score is 0."""
    def make():
        scanner = Scanner(templates)
        return scanner.scan
    return docs.withColumn(out, block_udf(f"struct<{RESULT}>", make)(F.col(text_col)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document (null ids and repeated rows stay rows of their own).
    ``score``: 1 if a template accepts, 0.5 if only a phrase occurs, else 0."""
    d = scan(only(docs, doc_id=id_col, text=text_col), "text", "r")
    return d.select("doc_id", "r.n_words", "r.n_base", "r.first_word", "r.last_word", "r.base_labels",
                    "r.labels", "r.score")


def sql(documents: str = "documents") -> str:
    """DuckDB SQL for ``report``: phrases by word positions, templates as regular
    expressions over the words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    places = " + ".join(f"len({_places(p)})" for p, _ in PHRASES)
    every = "[" + ", ".join(_places(p) for p, _ in PHRASES) + "]"
    base = "[" + ", ".join(f"CASE WHEN len({_places(p)}) > 0 THEN '{label}' END" for p, label in PHRASES) + "]"
    method = "[" + ", ".join(f"CASE WHEN regexp_matches(t, '{pattern(m)}') THEN '{label}' END"
                             for label, m in TEMPLATES) + "]"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {documents}),
j AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d),
m AS (SELECT doc_id, len(w) AS n_words, {places} AS n_base, flatten({every}) AS places,
             [x FOR x IN {base} IF x IS NOT NULL] AS b, [x FOR x IN {method} IF x IS NOT NULL] AS l FROM j)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_base AS BIGINT) AS n_base,
       CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
       array_to_string(list_sort(list_distinct(b)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(b, l))), ',') AS labels,
       CASE WHEN len(l) > 0 THEN 1.0::DOUBLE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM m"""


def _places(phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"[i FOR i IN range(1, len(w) - {len(words) - 2}) IF {same}]"
