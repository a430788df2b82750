"""Benchmark decontamination by suffix arrays over shards of the training text.

A shard is a block of documents held by one task. Its words become numbers of the benchmark's vocabulary (0: not in it, also
between documents). The suffix array of a shard lists the positions that begin with words an item begins a suffix with (its
first `_SEED` words, or one where an item is shorter), sorted by what follows as far as the longest item reaches. Other
suffixes can match no more than a word or two and are left out. Every suffix of every item is binary-searched for its longest
verbatim match and for the range of suffixes that share a whole window with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablekit.llm.arrays import ALPHANUMERIC, Words, blocks, words
from tablekit.llm.work import text_columns

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Benchmark text that one pass searches for; a larger benchmark is searched block by block.
QUERY_BYTES = 16 << 20
_SEED = 2


class Queries(NamedTuple):
    """Item texts as numbers of their own vocabulary, one after the other, each followed by a 0."""

    vocabulary: np.ndarray  # sorted word hashes; word k is number k + 1
    small: np.ndarray  # a bit table over the low bits of the hashes, to pass over most other words
    codes: np.ndarray
    position: np.ndarray  # where each suffix begins
    item: np.ndarray  # index of the item of each suffix
    room: np.ndarray  # words from there to the item's end
    window: np.ndarray  # words of the item's windows
    names: list[str]


def item_queries(items: list[tuple[str, str]], window: int = WINDOW) -> Queries:
    """Items (id, text) made ready for search; items without words are left out."""
    found = [words(b, ALPHANUMERIC, fold=True) for b in blocks(pa.array([t for _, t in items], pa.string()))]
    hashes = np.concatenate([w.hash for w in found]) if found else np.zeros(0, np.uint64)
    counts = np.concatenate([w.counts for w in found]) if found else np.zeros(0, np.int64)
    vocabulary, number = np.unique(hashes, return_inverse=True)
    small = np.zeros(1 << 22, bool)
    small[(vocabulary & np.uint64(len(small) - 1)).astype(np.int64)] = True
    item = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    position = np.arange(len(hashes)) + item
    codes = np.zeros(len(hashes) + len(counts) + 1, np.int32)
    codes[position] = number + 1
    return Queries(vocabulary, small, codes, position, item, ends[item] - np.arange(len(hashes)), np.minimum(counts, window), [n for n, _ in items])


class Shard(NamedTuple):
    """Codes of a shard's words (a 0 after each document) and its suffix array."""

    codes: np.ndarray
    suffixes: np.ndarray
    depth: int  # words by which suffixes are sorted


def _document_codes(found: Words, queries: Queries) -> np.ndarray:
    """The word numbers of a block; document d's words begin at found.first[d] + d."""
    number = np.zeros(len(found.hash), np.int32)
    maybe = np.flatnonzero(queries.small[(found.hash & np.uint64(len(queries.small) - 1)).astype(np.int64)])
    if len(maybe):
        at = np.minimum(np.searchsorted(queries.vocabulary, found.hash[maybe]), len(queries.vocabulary) - 1)
        number[maybe] = np.where(queries.vocabulary[at] == found.hash[maybe], at + 1, 0)
    codes = np.zeros(len(number) + len(found.first), np.int32)
    codes[np.arange(len(number)) + found.text] = number
    return codes


def build_shard(codes: np.ndarray, queries: Queries) -> Shard:
    """The suffix array, refined two words at a time: suffixes that are told apart already are not sorted again."""
    n, depth = len(codes), int(queries.room.max())
    seed = min(_SEED, int(queries.window[queries.window > 0].min()))
    base = np.int64(len(queries.vocabulary) + 2)
    starts = codes > 0
    if seed > 1:
        own = queries.codes.astype(np.int64)
        pairs = np.unique(own[:-1] * base + own[1:])
        pairs = pairs[(pairs % base > 0) & (pairs >= base)]
        pair = np.flatnonzero(starts[:-1] & starts[1:])
        key = codes[pair] * base + codes[pair + 1]
        known = np.zeros(1 << 20, bool)
        known[(pairs * 0x9E3779B1 >> 7) % len(known)] = True
        maybe = known[(key * 0x9E3779B1 >> 7) % len(known)]
        pair, key = pair[maybe], key[maybe]
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        pair = pair[pairs[at] == key] if len(pairs) else pair[:0]
    else:
        pair = np.flatnonzero(starts)
    at = pair[np.argsort(codes[pair], kind="stable")]
    split = np.ones(len(at), bool)
    split[1:] = codes[at][1:] != codes[at][:-1]
    more = np.arange(len(at))
    for step in range(1, depth, 2):
        group = np.cumsum(split) - 1
        more = more[np.bincount(group)[group[more]] > 1] if len(more) else more
        if not len(more):
            break
        block, parts = at[more], group[more]
        first = np.where(block + step < n, codes[np.minimum(block + step, n - 1)], 0).astype(np.int64)
        second = np.where((block + step + 1 < n) & (first > 0), codes[np.minimum(block + step + 1, n - 1)], 0)
        key = first * base + second
        order = np.lexsort((key, parts))
        at[more], key = block[order], key[order]
        split[more[1:]] |= (parts[1:] == parts[:-1]) & (key[1:] != key[:-1])
        more = more[key % base > 0]  # a suffix that has met a 0 is settled: what follows doesn't count
    return Shard(codes, at, depth)


def _compare(shard: Shard, queries: Queries, at: np.ndarray, query: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How each training suffix compares with its query's first `length` words: sign (-1, 0, 1) and words in common."""
    sign, common = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64)
    live = np.flatnonzero(length > 0)
    step = 0
    while len(live):
        where = at[live] + step
        here = np.where(where < len(shard.codes), shard.codes[np.minimum(where, len(shard.codes) - 1)], 0)
        there = queries.codes[query[live] + step]
        same = here == there
        sign[live[~same]] = np.sign(here[~same].astype(np.int64) - there[~same])
        common[live[same]] += 1
        step += 1
        live = live[same]
        live = live[length[live] > step]
    return sign, common


def _bound(shard: Shard, queries: Queries, query: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search: the first suffix not less than (or, upper, greater than) each query's first `length` words."""
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(shard.suffixes), np.int64)
    while (live := np.flatnonzero(low < high)).size:
        middle = (low[live] + high[live]) >> 1
        sign, _ = _compare(shard, queries, shard.suffixes[middle], query[live], length[live])
        right = sign <= 0 if upper else sign < 0
        low[live[right]] = middle[right] + 1
        high[live[~right]] = middle[~right]
    return low


def longest_matches(shard: Shard, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """For every item suffix: the length of its longest match in the shard and a position where it lies (-1: none).

    Matches of fewer words than the seed are not looked for; they come out as 0.
    """
    place = _bound(shard, queries, queries.position, queries.room, upper=False)
    best, where = np.zeros(len(place), np.int64), np.full(len(place), -1)
    for neighbour in (place - 1, place):
        inside = np.flatnonzero((neighbour >= 0) & (neighbour < len(shard.suffixes)))
        at = shard.suffixes[neighbour[inside]]
        _, common = _compare(shard, queries, at, queries.position[inside], queries.room[inside])
        better = common > best[inside]
        best[inside[better]], where[inside[better]] = common[better], at[better]
    return best, where


def window_matches(shard: Shard, queries: Queries, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix of `queries`, position in the shard) of every occurrence of a whole window."""
    length = queries.window[queries.item]
    full = np.flatnonzero(best >= length)
    if not len(full):
        return full, full
    low = _bound(shard, queries, queries.position[full], length[full], upper=False)
    high = _bound(shard, queries, queries.position[full], length[full], upper=True)
    size = high - low
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(full, size), shard.suffixes[np.repeat(low, size) + step]


def _covered(begin: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + length, -1)
    return np.cumsum(edge[:-1]) > 0


_FOUND = "doc_id long, n_words long, n_hit long, hits array<struct<begin:int,end:int>>, items array<string>, longest array<struct<item:string,words:int,at:int>>"


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Per document: words, words hit, hit spans (word positions), items with a whole window in it, and, for each such item,
    its longest verbatim match with the word position where it begins.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Null text has no words; a null item_id
    is named by the empty text; items without words match nothing; an empty table on either side gives no hits. Repeated
    documents are judged one by one. The benchmark is the query set: it is held in blocks of at most `query_bytes` (a longer
    item alone), each task searches one block after the other. Its text alone passes the driver, as its size is that of the
    query set, not of the corpus.
    """
    groups = _item_groups(benchmark, query_bytes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = [item_queries(g, window) for g in groups] if len(groups) == 1 else None
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(1)):
                yield _searched(ids.slice(block.first, block.last - block.first), words(block, ALPHANUMERIC, fold=True),
                                prepared or (item_queries(g, window) for g in groups))

    return (text_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
            .mapInArrow(search, _FOUND))


def _item_groups(benchmark: DataFrame, query_bytes: int) -> list[list[tuple[str, str]]]:
    rows = [(("" if r.item_id is None else str(r.item_id)), r.text or "") for r in text_columns(benchmark, "item_id", "text").toLocalIterator()]
    groups: list[list[tuple[str, str]]] = [[]]
    size = 0
    for row in rows:
        if size and size + len(row[1]) > query_bytes:
            groups.append([])
            size = 0
        groups[-1].append(row)
        size += len(row[1])
    return groups


def _searched(ids: pa.Array, found: Words, query_blocks) -> pa.RecordBatch:
    n_docs = len(ids)
    hit = np.zeros(len(found.hash) + n_docs + 1, bool)
    begins = found.first[:-1] + np.arange(n_docs)
    longest: list[dict[str, tuple[int, int]]] = [{} for _ in range(n_docs)]
    for queries in query_blocks:
        if not len(queries.position):
            continue
        shard = build_shard(_document_codes(found, queries), queries)
        best, _ = longest_matches(shard, queries)
        suffix, at = window_matches(shard, queries, best)
        if not len(suffix):
            continue
        hit |= _covered(at, queries.window[queries.item[suffix]], len(hit))
        _, common = _compare(shard, queries, at, queries.position[suffix], queries.room[suffix])
        doc, item = np.searchsorted(begins, at, "right") - 1, queries.item[suffix]
        order = np.lexsort((at, -common, item, doc))
        doc, item, common, at = doc[order], item[order], common[order], at[order]
        best_of = np.ones(len(at), bool)
        best_of[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        for d, i, k, w in zip(*(x[best_of].tolist() for x in (doc, item, common, at - begins[doc]))):
            name = queries.names[i]
            if k > longest[d].get(name, (0, 0))[0]:
                longest[d][name] = (k, w)
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[found.first[1:] + np.arange(n_docs)] - total[begins]
    spans: list[list[dict]] = [[] for _ in range(n_docs)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        d = int(np.searchsorted(begins, a, "right")) - 1
        spans[d].append({"begin": a - int(begins[d]), "end": b - int(begins[d])})
    return pa.RecordBatch.from_pydict({
        "doc_id": ids, "n_words": pa.array(found.counts, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
        "hits": pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
        "items": pa.array([sorted(x) for x in longest], pa.list_(pa.string())),
        "longest": pa.array([[{"item": k, "words": v[0], "at": v[1]} for k, v in sorted(x.items())] for x in longest],
                            pa.list_(pa.struct([("item", pa.string()), ("words", pa.int32()), ("at", pa.int32())]))),
    })


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest of `find_matches`: counts, a hash of the sorted item ids, and the verdict."""
    return find_matches(docs, benchmark, window).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The rows of `docs` without a hit, all columns kept; each row is judged by its own text, without a shuffle."""
    groups, place = _item_groups(benchmark, query_bytes), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = [item_queries(g, window) for g in groups] if len(groups) == 1 else None
        for batch in batches:
            clean = []
            for block in blocks(batch.column(place)):
                nothing = pa.nulls(block.last - block.first, pa.int64())
                found = _searched(nothing, words(block, ALPHANUMERIC, fold=True), prepared or (item_queries(g, window) for g in groups))
                clean.append(found.column("n_hit").to_numpy(zero_copy_only=False) == 0)
            if clean:
                yield batch.filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(keep, docs.schema)
