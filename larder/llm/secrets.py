"""Secret scans (9): base patterns and learned format automata.

The base patterns find assignments, access keys and hex strings.  What they
find, labelled by its kind, trains one probabilistic automaton per kind: a
prefix tree over character classes whose states are merged while their
frequencies are statistically compatible (Hoeffding bound, red-blue order).
Every other candidate string is then scored by its likelihood per character
under each automaton; those at least as likely as nearly all labelled ones of a
kind are added as spans of kind ``format``.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.text import batch_udf, block_udf, only
from larder.session import cut_lineage

KINDS = ("assign", "access", "hex")
SAMPLE = 1500             # distinct labelled credentials per kind in the fitting sample
ALPHA = 0.01              # Hoeffding bound's confidence for merging states
QUANTILE = 0.02           # share of held-back credentials below the accepted likelihood
MIN_LENGTH = 16           # shortest candidate

# fixed patterns of the contract; letters of the assignment in either case (ASCII)
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)

RESULT = ("base:array<struct<kind:string,start:int,stop:int,value:string>>,"
          "candidates:array<struct<start:int,stop:int,value:string>>")
_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()),
                            ("value", pa.string())]))
_CAND = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, stop, value), by start and then kind as listed.

    Matches are leftmost and do not overlap within a kind.  A hex run or access
    key below its length can be skipped while matching, as a shorter one
    cannot begin later in the same run; an assignment with a short value is a
    match that is dropped afterwards, as it uses up its text.
    """
    out = [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return out


def candidate_spans(text: str, base: list) -> list[tuple[int, int, str]]:
    """Long strings with a digit and a letter that no base span touches."""
    out = []
    for m in _CANDIDATE.finditer(text):
        s, (a, b) = m[0], m.span()
        if any(x[1] < b and a < x[2] for x in base):
            continue
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            out.append((a, b, s))
    return out


def _scan(arr: pa.Array) -> pa.Array:
    base, cand = [], []
    for t in arr.to_pylist():
        b = base_spans(t) if t else []
        base.append([{"kind": k, "start": x, "stop": y, "value": v} for k, x, y, v in b])
        cand.append([{"start": x, "stop": y, "value": v} for x, y, v in candidate_spans(t, b)] if t else [])
    return pa.StructArray.from_arrays([pa.array(base, _BASE), pa.array(cand, _CAND)],
                                      names=["base", "candidates"])


def scan(docs: DataFrame, text_col: str = "text", out: str = "found") -> DataFrame:
    """``docs`` with a struct column of base spans and candidates (code points, end
    exclusive).  Null and empty texts have none."""
    return docs.withColumn(out, block_udf(f"struct<{RESULT}>", lambda: _scan)(F.col(text_col)))


# character classes of the automata's alphabet, with their sizes
_CLASSES = [("0123456789", 10), ("abcdef", 6), ("ghijklmnopqrstuvwxyz", 20), ("ABCDEF", 6),
            ("GHIJKLMNOPQRSTUVWXYZ", 20), ("+", 1), ("/", 1), ("_", 1), ("=", 1), ("-", 1), (".", 1)]
_CLASS_OF = {c: i for i, (chars, _) in enumerate(_CLASSES) for c in chars}


class Automaton:
    """A probabilistic automaton inferred by state merging from strings."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [{}]
        self.end, self.seen = [0], [0]
        for s in strings:
            q = 0
            for c in s:
                self.seen[q] += 1
                k = _CLASS_OF[c]
                self.count[q][k] = self.count[q].get(k, 0) + 1
                if k not in self.next[q]:
                    self.next[q][k] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.end.append(0)
                    self.seen.append(0)
                q = self.next[q][k]
            self.seen[q] += 1
            self.end[q] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen[a], self.seen[b]
            if not n or not m:
                continue
            if self._differ(self.end[a], n, self.end[b], m):
                return False
            for k in {*self.count[a], *self.count[b]}:
                if self._differ(self.count[a].get(k, 0), n, self.count[b].get(k, 0), m):
                    return False
                if k in self.next[a] and k in self.next[b]:
                    todo.append((self.next[a][k], self.next[b][k]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` into the state ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.end[a] += self.end[b]
            for k, n in self.count[b].items():
                self.count[a][k] = self.count[a].get(k, 0) + n
            for k, q in self.next[b].items():
                if k in self.next[a]:
                    todo.append((self.next[a][k], q))
                else:
                    self.next[a][k] = q

    def _merge_states(self) -> None:
        red = [0]
        blue = [(0, k) for k in sorted(self.next[0])]
        while blue:
            blue.sort(key=lambda x: -self.seen[self.next[x[0]][x[1]]])
            p, k = blue.pop(0)
            q = self.next[p][k]
            for r in red:
                if self._compatible(r, q):
                    self.next[p][k] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
            known = set(red)
            blue = [(p, k) for p in red for k in sorted(self.next[p]) if self.next[p][k] not in known]
        name = {q: i for i, q in enumerate(red)}
        self.next = [{k: name[self.next[q][k]] for k in self.next[q]} for q in red]
        for field in ("count", "end", "seen"):
            setattr(self, field, [getattr(self, field)[q] for q in red])

    def likelihood(self, s: str) -> float:
        """Log-probability per character (the end counts as one); characters of a
        class share its probability evenly; unseen steps get half a count."""
        q, total = 0, 0.0
        for c in s:
            k = _CLASS_OF.get(c)
            if k is None:
                return -math.inf
            total += math.log((self.count[q].get(k, 0) + 0.05) / (self.seen[q] + 0.6) / _CLASSES[k][1])
            if k not in self.next[q]:
                return total - 8.0 * (len(s) + 1)
            q = self.next[q][k]
        total += math.log((self.end[q] + 0.05) / (self.seen[q] + 0.6))
        return total / (len(s) + 1)


def fit(found: DataFrame, col: str = "found", sample: int = SAMPLE) -> dict[str, tuple[Automaton, float]]:
    """One automaton per kind with labelled credentials, and the likelihood that
    all but QUANTILE of held-back labelled credentials reach.

    Trained on at most ``sample`` distinct credentials per kind, those with the
    smallest hash: a documented bound on what the driver holds.
    """
    seen = found.select(F.explode(f"{col}.base").alias("b")).select("b.kind", "b.value").filter(
        f"length(value) between {MIN_LENGTH} and 200").distinct()
    out = {}
    for kind in KINDS:
        rows = seen.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        values = [r.value for r in rows]
        if len(values) < 20:
            continue
        back, train = values[::5], [v for i, v in enumerate(values) if i % 5]
        a = Automaton(train)
        scores = sorted(a.likelihood(v) for v in back)
        out[kind] = (a, scores[int(QUANTILE * len(scores))])
    return out


def add_formats(found: DataFrame, models: dict, col: str = "found", out: str = "spans") -> DataFrame:
    """``found`` with an array ``out`` of all spans: base spans, then candidates that
    an automaton accepts (kind ``format``), by start."""
    held = found.sparkSession.sparkContext.broadcast(_state(models))

    def make():
        autos = _automata(held.value)
        return lambda candidates: pa.array(
            [None if row is None else [any(a.likelihood(v) >= least for a, least in autos) for v in row]
             for row in candidates.to_pylist()], pa.list_(pa.bool_()))
    likely = batch_udf("array<boolean>", make, 4096)
    values = F.transform(f"{col}.candidates", lambda c: c["value"])
    hit = F.filter(F.arrays_zip(F.col(f"{col}.candidates").alias("c"), F.col("__likely").alias("ok")),
                   lambda x: x["ok"])
    extra = F.transform(hit, lambda x: F.struct(x["c"]["start"].alias("start"), F.lit(3).alias("rank"),
                                                F.lit("format").alias("kind"), x["c"]["stop"].alias("stop")))
    base = F.transform(f"{col}.base", lambda b: F.struct(
        b["start"].alias("start"), (F.array_position(F.array(*map(F.lit, KINDS)), b["kind"]) - 1).cast("int").alias("rank"),
        b["kind"].alias("kind"), b["stop"].alias("stop")))
    # most documents have no candidate: only the others go through Python
    none = F.array().cast("array<boolean>")
    return found.withColumn("__likely", F.when(F.size(values) == 0, none).otherwise(likely(values))).withColumn(
        out, F.array_sort(F.concat(base, extra))).drop("__likely")


def _joined(spans, only_base: bool):
    s = F.filter(spans, lambda x: x["rank"] < 3) if only_base else F.col(spans)
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def _count(kind: str):
    return F.size(F.filter("found.base", lambda b: b["kind"] == kind))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base spans per kind, the digest of the base
    spans and all spans as text.  Null ids and repeated rows stay.

    Texts are scanned once; the found strings go to the shared folder, from
    where the automata are fitted and the candidates scored.
    """
    found = cut_lineage(scan(only(docs, doc_id=id_col, text=text_col)).select("doc_id", "found"))
    d = add_formats(found, fit(found))
    return d.select("doc_id", *[_count(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_joined("spans", True), 256).alias("base_sha256"),
                    _joined("spans", False).alias("spans"))


def _automata(held: dict) -> list[tuple[Automaton, float]]:
    out = []
    for state, least in held.values():
        a = Automaton.__new__(Automaton)
        a.__dict__.update(state)
        out.append((a, least))
    return out


def _state(models: dict) -> dict:
    return {k: ({n: getattr(a, n) for n in ("next", "count", "end", "seen")}, t) for k, (a, t) in models.items()}


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span (overlapping ones united) replaced by ``mark``;
    texts without secrets and all other columns stay as they are.

    The automata are fitted on what a first pass finds in the same documents;
    the second pass finds, scores and cuts in one function over the text.
    """
    first = cut_lineage(scan(docs.select(F.col(text_col).alias("text"))).select("found")
                        .filter("size(found.base) > 0"))
    held = docs.sparkSession.sparkContext.broadcast(_state(fit(first)))

    def make():
        autos = _automata(held.value)

        def cut(arr: pa.Array) -> pa.Array:
            out = []
            for t in arr.to_pylist():
                if t:
                    base = base_spans(t)
                    spans = [(a, b) for _, a, b, _ in base] + [
                        (a, b) for a, b, v in candidate_spans(t, base)
                        if any(x.likelihood(v) >= least for x, least in autos)]
                    keep, at = [], 0
                    for a, b in sorted(spans):
                        if a >= at:
                            keep += [t[at:a], mark]
                        at = max(at, b)
                    t = "".join(keep) + t[at:]
                out.append(t)
            return pa.array(out, pa.string())
        return cut
    return docs.withColumn(text_col, block_udf("string", make)(F.col(text_col)))
