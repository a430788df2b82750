"""Secret scans: fixed patterns, and look-alikes found by automata inferred from the credentials that the patterns label."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablekit.llm.arrays import blocks
from tablekit.llm.automata import Automaton, infer
from tablekit.llm.work import text_columns

#: The base patterns in the order of their kinds, the group whose length counts, and its least length.
KINDS = ("assign", "access", "hex")
_BASE = (
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    (re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
#: The kind of spans that the automata add. Candidates are runs of key characters outside the base spans, of at least so many, and their parts between
#: `=` and `/` (a name before a value, a path before a key) without dots at their ends.
GRAMMAR, LEAST = "grammar", 8
_RUN, _PART = re.compile(r"[A-Za-z0-9+/_.=-]{8,}"), re.compile(r"[A-Za-z0-9+_-][A-Za-z0-9+_.-]{6,}[A-Za-z0-9+_-]")
#: Examples that an automaton is inferred from, at most (those of smallest hash): of a kind, and of ordinary runs.
EXAMPLES = 600
#: A candidate must score like all but this share of the kind's held-out examples, and be so many nats likelier as a
#: credential than as an ordinary run.
_TAIL, _ODDS = 0.02, 8.0
#: Rounds in which examples change between ordinary runs and credentials, at most.
_ROUNDS = 6


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the fixed patterns, leftmost and not overlapping within a kind, by start, then kind."""
    found = []
    for kind, (pattern, group, least) in enumerate(_BASE):
        found += [(kind, *m.span(), m.group(group)) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(found, key=lambda x: (x[1], x[0]))


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """Start and end of all that may be a credential outside the base spans: whole runs and their parts."""
    found, at = [], 0
    taken: list[list[int]] = []  # the base spans' union
    for _, begin, end, _ in base:
        if taken and begin <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([begin, end])
    for m in _RUN.finditer(text):
        begin, last = m.span()
        while at < len(taken) and taken[at][1] <= begin:
            at += 1
        cuts = [begin]
        for k in range(at, len(taken)):
            if taken[k][0] >= last:
                break
            cuts += taken[k]
        cuts.append(last)
        for a, b in zip(cuts[::2], cuts[1::2]):
            if b - a >= LEAST:
                found.append((a, b))
                found += [p.span() for p in _PART.finditer(text, a, b) if p.span() != (a, b)]
    return found


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """The ids and texts of a block at a time; null is empty."""
    for batch in batches:
        for block in blocks(batch.column(1)):
            size = block.last - block.first
            yield batch.column(0).slice(block.first, size), [x or "" for x in batch.column(1).slice(block.first, size).to_pylist()]


def _examples(docs: DataFrame, bound: int) -> list[list[str]]:
    """For each kind, then for candidates, the `bound` distinct strings of smallest hash. Every block gives out its own smallest, among which the whole table's are."""
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            own: list[set[str]] = [set() for _ in range(len(KINDS) + 1)]
            for text in texts:
                base = base_spans(text)
                for kind, _, _, value in base:
                    own[kind].add(value)
                own[-1].update(text[a:b] for a, b in candidates(text, base))
            for kind, some in enumerate(own):
                if some:
                    values = np.array(sorted(some), object)
                    hashes = pd.util.hash_array(values).view(np.int64)
                    first = np.argsort(hashes, kind="stable")[:bound]
                    yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(first), kind, np.int32)), "hash": pa.array(hashes[first]), "value": pa.array(values[first], pa.string())})

    found = text_columns(docs, "doc_id", "text").mapInArrow(least, "kind int, hash long, value string").distinct()
    place = F.row_number().over(Window.partitionBy("kind").orderBy("hash", "value"))
    rows = found.withColumn("place", place).where(F.col("place") <= bound).orderBy("kind", "place").collect()
    return [[r.value for r in rows if r.kind == kind] for kind in range(len(KINDS) + 1)]


class Grammar(NamedTuple):
    formats: list[tuple[str, Automaton, float, tuple[int, int]]]  # kind, automaton, least likelihood per character, shortest and longest example
    ordinary: Automaton

    def odds(self, values: list[str]) -> np.ndarray:
        """By how many nats each value is likelier as a credential of the kind that suits it best than as an ordinary run; -inf where no kind takes it."""
        found = np.full(len(values), -np.inf)
        if values and self.formats:
            plain, sizes = self.ordinary.likelihood(values), np.array([len(v) + 1 for v in values])
            for _, automaton, least, (short, long) in self.formats:
                score = automaton.likelihood(values)
                fits = (score >= least) & (sizes > short) & (sizes <= long + 1)
                found = np.maximum(found, np.where(fits, (score - plain) * sizes, -np.inf))
        return found

    def credentials(self, values: list[str]) -> np.ndarray:
        """Which values look like a credential of some kind rather than an ordinary run."""
        return self.odds(values) >= _ODDS


def fit_grammar(docs: DataFrame, examples: int = EXAMPLES) -> Grammar:
    """An automaton per kind from the values that its pattern labels, and one of ordinary runs, each from at most `examples` distinct strings.

    Every fourth example of a kind is held out to set its threshold, and its lengths bound those of a credential; a kind with fewer than 20 is left out. Candidates are a mixture of ordinary runs and of
    credentials that no pattern marks: at first those that no kind takes are ordinary; then those that the ordinary model explains better than any kind are put
    back, and others taken out, until nothing changes. So neither many unmarked credentials nor a loose kind spoil the model.
    """
    *labelled, runs = _examples(docs, examples)
    formats = []
    for name, values in zip(KINDS, labelled):
        if len(values) >= 20:
            automaton = infer([v for i, v in enumerate(values) if i % 4])
            sizes = [len(v) for v in values]
            formats.append((name, automaton, float(np.quantile(automaton.likelihood(values[::4]), _TAIL)), (min(sizes), max(sizes))))
    free = Grammar(formats, infer(runs)).odds(runs) == -np.inf
    if free.sum() < 20:
        free[:] = True
    for _ in range(_ROUNDS):
        grammar = Grammar(formats, infer([v for v, f in zip(runs, free) if f]))
        now = grammar.odds(runs) <= 0
        if not formats or (now == free).all() or not now.any():
            break
        free = now
    return grammar


def find_secrets(docs: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """One row per document: doc_id and found, an array of (kind, start, end) by start, then kind as listed, grammar last.

    Positions are code points, the end exclusive. Base spans are the fixed patterns' and stay whatever the automata say. Every candidate outside them
    is scored by its own likelihood; of those taken for a credential the likeliest stand that don't overlap (of equal ones the longer, then the first). Null or
    empty text has none; texts of any length are scanned whole; rows are judged one by one, so repeated rows come out alike; without labelled credentials nothing is
    added; an empty table gives no rows; other columns are not looked at.
    """
    grammar = fit_grammar(docs, examples)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            base = [base_spans(text) for text in texts]
            places = [(k, a, b) for k, text in enumerate(texts) for a, b in candidates(text, base[k])]
            values, which = np.unique(np.array([texts[k][a:b] for k, a, b in places], object), return_inverse=True) if places else (np.zeros(0, object), np.zeros(0, int))
            odds = grammar.odds(list(values))[which]
            out = [[(x[1], x[0], x[2]) for x in own] for own in base]
            good = sorted((-odds[i], places[i][1] - places[i][2], places[i]) for i in np.flatnonzero(odds >= _ODDS).tolist())
            kept: dict[int, list[tuple[int, int]]] = {}
            for _, _, (k, a, b) in good:
                own = kept.setdefault(k, [])
                i = bisect(own, (a, b))
                if (not i or own[i - 1][1] <= a) and (i == len(own) or b <= own[i][0]):
                    own.insert(i, (a, b))
            for k, own in kept.items():
                out[k] += [(a, len(KINDS), b) for a, b in own]
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "found": pa.array([[{"kind": (*KINDS, GRAMMAR)[k], "start": a, "end": b} for a, k, b in sorted(own)] for own in out], span)})

    return text_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, found array<struct<kind:string,start:int,end:int>>")


def secrets_report(docs: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """The digest of `find_secrets`: counts per base kind, a hash of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("found", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    return find_secrets(docs, examples).select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(text(F.filter("found", lambda x: x.kind != GRAMMAR)), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
