"""License scans: word k-grams of texts joined to positions in license templates, votes by diagonal, verified spans."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablekit.llm.arrays import ALPHANUMERIC, Block, Words, blocks, mixed, words
from tablekit.llm.work import maybe_among, text_columns, written

#: Phrases whose places are always reported, with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Label and text of the templates looked for by default: notices, and the wording of short licenses.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without "
            "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in "
            "all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
            "PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of "
            "source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
            "this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
)
#: Template positions sent to all tasks at a time; more templates are joined in further rounds.
JOINED_AT_ONCE = 1 << 18
_SPANS = "array<struct<label:string,first:int,last:int,score:double>>"


def _cut(text: str) -> tuple[Block, Words]:
    block = next(blocks(pa.array([text])))
    return block, words(block, ALPHANUMERIC, fold=True)


def _grams(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The index of every word that begins k words of one text, and the hash of those k words."""
    n = len(found.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = found.text
    at = np.flatnonzero(text[:n] == text[k - 1:])
    total = np.zeros(len(at), np.uint64)
    for i in range(k):
        total = total * np.uint64(0x9FB21C651E98DF25) + found.hash[at + i]
    return at, mixed(total)


def _gap(m: int) -> int:
    """Words by which neighbouring diagonals of a template of m words may differ."""
    return min(32, max(1, m // 4))


def _spelled(block: Block, found: Words, first: int, last: int) -> list[str]:
    return [block.data[a:b].tobytes().lower().decode("utf-8") for a, b in zip(found.start[first:last].tolist(), found.end[first:last].tolist())]


def _diagonals(keyed: DataFrame, table: list[tuple], k: int, votes: float) -> DataFrame:
    """doc_id, key, template, low, high: runs of neighbouring diagonals of each text with enough votes for a template."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                found = words(block, ALPHANUMERIC, fold=True)
                at, gram = _grams(found, k)
                text = np.searchsorted(found.first, at, "right") - 1
                row = pa.array(block.first + text)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array((at - found.first[text]).astype(np.int32)), pa.array(gram.view(np.int64))], names=["doc_id", "key", "place", "gram"])

    spark = keyed.sparkSession
    grams = keyed.mapInArrow(run, "doc_id long, key long, place int, gram long")
    hits = []
    for first in range(0, max(len(table), 1), JOINED_AT_ONCE):
        some = spark.createDataFrame(table[first:first + JOINED_AT_ONCE], "gram long, template int, at int, size int, gap int")
        hits.append(grams.join(F.broadcast(some), "gram"))
    one = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    chain = Window.partitionBy("doc_id", "key", "template", "chain")
    found = reduce(DataFrame.unionAll, hits).groupBy("doc_id", "key", "template", "size", "gap", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count_distinct("place").alias("n"))
    found = found.withColumn("far", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(one) > F.col("gap"), F.lit(True)).cast("int"))
    # A run that is longer than its template (a text that repeats it) is cut, so that a run spans less than two templates.
    found = found.withColumn("chain", F.sum("far").over(one)).withColumn("part", F.expr("diagonal") - F.min("diagonal").over(chain))
    runs = found.groupBy("doc_id", "key", "template", "size", "chain", F.expr("part div size").alias("part")).agg(F.sum("n").alias("n"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    return runs.where(F.col("n") >= F.lit(votes) * (F.col("size") - (k - 1))).select("doc_id", "key", "template", "low", "high")


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, k: int = 4, votes: float = 0.2, least: float = 0.75, whole_below: int = 12) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, spans, score.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Every k words of every text are joined to the
    places of the templates (label, text; at least k words each) where they stand; the matches of a text are counted by
    template and diagonal (place in the text less place in the template), diagonals close to each other are merged, and where
    a run has at least the share `votes` of the template's k-grams, template and text are aligned there word by word. A span stands if
    runs of two or more equal words cover the share `least` of the template, which is its score; a template of fewer than `whole_below`
    words, where one word tells licenses apart, must be covered whole. Of overlapping spans the one with the most equal words stands, then
    the first. Phrases are counted at every place where their words stand one after the other; their labels always belong to
    `labels`, at a score of 1. n_base, first_word and last_word are the number of those places, the smallest and the largest (null if
    none); spans are label, first and last word (exclusive) and score, by place. score is the largest one, 0 without any.

    Null is the empty text, which has no words. Texts of any length are scanned whole. Rows that agree in id (null too)
    and text are judged alike; copies under different ids are found each. Without templates only phrases count. An empty table gives no rows;
    other columns are not looked at. Templates are small and given by the caller; they are sent to all tasks in rounds of
    `JOINED_AT_ONCE` positions.
    """
    spark = docs.sparkSession
    bodies, table = [], []
    for t, (label, text) in enumerate(templates):
        block, found = _cut(text)
        at, gram = _grams(found, k)
        if not len(at):
            raise ValueError(f"a template of {label!r} has fewer than {k} words")
        m = len(found.hash)
        bodies.append((label, _spelled(block, found, 0, m)))
        table += [(int(g), t, int(a), m, _gap(m)) for a, g in zip(at, gram.view(np.int64))]
    sought = [(_cut(phrase)[1].hash, label) for phrase, label in phrases]

    keyed = text_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    runs = _diagonals(keyed, table, k, votes).groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("template", "low", "high"))).alias("runs"))
    runs = written(runs, "licenses").select(F.col("doc_id").alias("_doc_id"), F.col("key").alias("_key"), "runs")
    marked = maybe_among(keyed, "key", runs.select("_key"))
    near = marked.where("_maybe").join(runs.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("key") == F.col("_key")), "left").select("doc_id", "text", "runs")
    rest = marked.where("not _maybe").select("doc_id", "text", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))

    def aligned(block: Block, found: Words, text: int, template: int, low: int, high: int) -> tuple | None:
        label, body = bodies[template]
        n = int(found.counts[text])
        a, b = max(0, low), min(n, high + len(body))
        own = _spelled(block, found, int(found.first[text]) + a, int(found.first[text]) + b)
        equal = [m for m in SequenceMatcher(None, body, own, autojunk=False).get_matching_blocks() if m.size >= 2]
        same = sum(m.size for m in equal)
        return (-same, a + equal[0].b, a + equal[-1].b + equal[-1].size, label, same / len(body)) if same >= (least if len(body) >= whole_below else 1) * len(body) else None

    def judged(block: Block, found: Words, text: int, runs: list[dict]) -> list[tuple]:
        """Spans that don't overlap, by place."""
        kept: list[tuple] = []
        for same, first, last, label, score in sorted({x for r in runs if (x := aligned(block, found, text, r["template"], r["low"], r["high"]))}):
            i = bisect(kept, (first, last))
            if (not i or kept[i - 1][1] <= first) and (i == len(kept) or last <= kept[i][0]):
                kept.insert(i, (first, last, label, score))
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = words(block, ALPHANUMERIC, fold=True)
                size, text = block.last - block.first, found.text
                n_base, low, high = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.full(size, -1)
                base: list[set[str]] = [set() for _ in range(size)]
                for phrase, label in sought:
                    m = len(phrase)
                    n = len(text) - m + 1
                    if n <= 0:
                        continue
                    at = np.flatnonzero(np.logical_and.reduce([found.hash[i:n + i] == h for i, h in enumerate(phrase)]) & (text[:n] == text[m - 1:]))
                    where = text[at]
                    np.add.at(n_base, where, 1)
                    np.minimum.at(low, where, at - found.first[where])
                    np.maximum.at(high, where, at - found.first[where])
                    for i in np.unique(where).tolist():
                        base[i].add(label)
                spans: list[list[tuple]] = [[] for _ in range(size)]
                for i, r in enumerate(batch.column(2).slice(block.first, size).to_pylist()):
                    if r:
                        spans[i] = judged(block, found, i, r)
                none = n_base == 0
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(block.first, size), "n_words": pa.array(found.counts, pa.int64()), "n_base": pa.array(n_base),
                    "first_word": pa.array(low, mask=none), "last_word": pa.array(high, mask=none),
                    "base_labels": pa.array(map(sorted, base), pa.list_(pa.string())),
                    "labels": pa.array([sorted(b | {s[2] for s in own}) for b, own in zip(base, spans)], pa.list_(pa.string())),
                    "spans": pa.array([[dict(zip(("first", "last", "label", "score"), s)) for s in own] for own in spans], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))),
                    "score": pa.array([1.0 if b else max((s[3] for s in own), default=0.0) for b, own in zip(base, spans)], pa.float64())})

    return near.unionAll(rest).mapInArrow(run, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, spans {_SPANS}, score double")
