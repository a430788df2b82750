"""Source divergence audit: term counts from sorted word pointers, and how far the sources of a language differ by them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablekit.llm.arrays import Block, blocks, spans
from tablekit.llm.work import text_columns, written

_codes = np.arange(256)
#: `[^\x00-\x40\x5B-\x60\x7B-\x7F]`: ASCII letters and all that is not ASCII.
LETTERS = (_codes >= 128) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text whose pointers are sorted together (a longer text is a shard of its own), and counts that meet in one group
#: of sources at a time.
SHARD_BYTES, GROUP_ROWS = 1 << 23, 1 << 18
#: Sources whose pairs are summed together.
SOURCES_AT_ONCE = 64
#: Shares are whole numbers out of this.
UNIT = 1_000_000_000


def sorted_pointers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the words at [start, end) of `data` by their bytes, and where a run of equal words begins in it.

    A multikey quicksort whose characters are eight bytes: pointers are sorted by the eight bytes at their depth, and runs
    of equal ones whose words go on are sorted by the next eight, until every run is of equal words. Equal words keep their order.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))
    n = len(start)
    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    part, depth = np.arange(n), 0  # places in `order` of runs that go on
    while len(part):
        own = order[part]
        left = end[own] - start[own] - depth
        key = eight[np.minimum(start[own] + depth, len(data))].astype(np.uint64)
        short = np.clip(8 - left, 0, 8)
        key = np.where(short < 8, key >> (np.minimum(short, 7) * 8).astype(np.uint64) << (np.minimum(short, 7) * 8).astype(np.uint64), 0)
        run = np.cumsum(new[part])
        by = np.argsort(key, kind="stable") if depth == 0 else np.lexsort((key, run))
        own, key, left = own[by], key[by], left[by]  # runs stay in their places, since they are the first key
        order[part] = own
        other = np.ones(len(part), bool)
        other[1:] = (key[1:] != key[:-1]) | (run[1:] != run[:-1])
        new[part] |= other
        first = np.flatnonzero(other)
        sizes = np.diff(np.append(first, len(part)))
        longest = np.maximum.reduceat(left, first)  # words of a run may end here, or go on
        part = part[np.repeat((sizes > 1) & (longest > 8), sizes)]
        depth += 8
    return order, new


def _spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans as strings."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    body = data[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(body))


def _shard_counts(block: Block, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Term, group, occurrences and documents: one row for each term of a shard and group of texts that has it."""
    start, end, first = spans(block, LETTERS)
    text = np.repeat(np.arange(len(group), dtype=np.int32), np.diff(first))
    place = np.empty(len(group), np.int32)
    place[np.argsort(group, kind="stable")] = np.arange(len(group))
    pointers = np.argsort(place[text], kind="stable").astype(np.int32)  # texts of a group next to each other, words in their order
    start, end, text = start[pointers].astype(np.int32), end[pointers].astype(np.int32), text[pointers]
    data = _LOWER[block.data]
    order, new = sorted_pointers(data, start, end)
    text = text[order]
    g = group[text]
    fresh = new.copy()
    fresh[1:] |= g[1:] != g[:-1]
    first_in_text = fresh.copy()
    first_in_text[1:] |= text[1:] != text[:-1]
    first = np.flatnonzero(fresh)
    term = order[first]
    return _spelled(data, start[term].astype(np.int64), end[term].astype(np.int64)), g[first], np.diff(np.append(first, len(order))), np.add.reduceat(first_in_text.astype(np.int64), first) if len(first) else first


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents): terms are runs of ASCII letters and non-ASCII characters, A-Z
    lower-cased. Null text, lang and source are empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch.column(i).fill_null("") for i in (0, 1)]
            for block in blocks(batch.column(2), SHARD_BYTES):
                size = block.last - block.first
                coded = [c.slice(block.first, size).dictionary_encode() for c in names]
                lang, source = (c.indices.to_numpy().astype(np.int64) for c in coded)
                wide = len(coded[1].dictionary)
                term, group, n, df = _shard_counts(block, lang * wide + source)
                if len(n):
                    yield pa.RecordBatch.from_arrays([coded[0].dictionary.take(pa.array(group // wide)), coded[1].dictionary.take(pa.array(group % wide)), term, pa.array(n, pa.int64()), pa.array(df, pa.int64())], names=["lang", "source", "term", "n", "df"])

    found = text_columns(docs, "lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(n: str, total: str) -> Column:
    """1 + floor(UNIT * (n + 1) / total), in decimals, so that no count is too large."""
    return F.expr(f"1 + cast({UNIT} as decimal(10,0)) * cast({n} + 1 as decimal(20,0)) div cast({total} as decimal(20,0))")


_DISTANCE = "(p - q) * (p - q) div q"  # shares of a group are at most 2 * UNIT, so the square fits a long


def kept_terms(docs: DataFrame, least_documents: int = 3) -> tuple[DataFrame, DataFrame]:
    """Two written tables. Terms: lang, source, term, n, lang_n of the terms that at least so many documents of their language
    have, where n > 0. Groups: every lang and source of the table with n (occurrences of kept terms), lang_n and v (number of
    kept terms) of its language, rows (of the language in the other table), and place (from 0 within the language)."""
    same = Window.partitionBy("lang", "term")
    counts = count_terms(docs).withColumns({"df": F.sum("df").over(same), "lang_n": F.sum("n").over(same), "first": F.min("source").over(same) == F.col("source")})
    terms = written(counts.where(F.col("df") >= least_documents).select("lang", "source", "term", "n", "lang_n", "first"), "terms")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = text_columns(docs, "lang", "source").select(name("lang"), name("source")).distinct()
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = terms.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum(F.col("first").cast("long")).alias("v"), F.count("*").alias("rows"))
    groups = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "lang_n", "v", "rows"])
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    return terms.drop("first"), written(groups, "groups")


def _pair_sums(table: pa.Table) -> pa.Table:
    """One bucket of a language's terms and two blocks of its sources. Rows without a term are the sources with the share of a term they
    don't have; the others are terms they have. For each ordered pair between the blocks: base, the distance at a term that
    neither has, and extra, what the bucket's terms add to base times the number of all terms."""
    column = lambda c: table.column(c).combine_chunks()
    place, share, term = column("place").to_numpy(), column("p").to_numpy(), column("term").dictionary_encode()
    known = term.indices.is_valid().to_numpy(zero_copy_only=False)
    sources = np.argsort(place[~known])
    zero, sources = share[~known][sources], place[~known][sources]
    code = term.indices.fill_null(0).to_numpy()[known]
    at = np.searchsorted(sources, place[known])
    by = np.argsort(code, kind="stable")
    code, at, share = code[by], at[by], share[known][by]
    a, b = column("a")[0].as_py(), column("b")[0].as_py()
    base = (zero[:, None] - zero) ** 2 // zero
    extra = np.zeros_like(base)
    count = len(term.dictionary)
    for first in range(0, count, 4096):
        last = min(first + 4096, count)
        some = slice(*np.searchsorted(code, [first, last]))
        shares = np.repeat(zero[None, :], last - first, 0)
        shares[code[some] - first, at[some]] = share[some]
        for g in range(len(sources)):
            extra[g] += ((shares[:, [g]] - shares) ** 2 // shares - base[g]).sum(0)
    block = sources // SOURCES_AT_ONCE
    g, h = np.nonzero(((block[:, None] == a) & (block == b)) | ((block[:, None] == b) & (block == a)))
    g, h = g[g != h], h[g != h]
    lang = pa.repeat(column("lang")[0], len(g))
    return pa.table({"lang": lang, "place": sources[g], "other": sources[h], "extra": extra[g, h], "base": base[g, h]})


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source), value: the sum over all kept terms of the language."""
    blocks_of = F.expr(f"(max(place) over (partition by lang)) div {SOURCES_AT_ONCE} + 1")
    sized = groups.withColumn("blocks", blocks_of).withColumn("buckets", F.ceil(2 * F.col("rows") / (F.col("blocks") * GROUP_ROWS)) + 1)
    met = F.explode(F.expr("sequence(0, blocks - 1)"))
    own = F.expr(f"place div {SOURCES_AT_ONCE}")
    key = lambda df: df.withColumn("with", met).select("lang", F.least(own, "with").cast("int").alias("a"), F.greatest(own, "with").cast("int").alias("b"), "bucket", "place", "term", "p")
    absent = sized.withColumn("bucket", F.explode(F.expr("sequence(0L, buckets - 1)"))).withColumns({"term": F.lit(None).cast("string"), "p": F.when(F.col("v") > 0, _share("0", "n + v")).otherwise(1)})
    present = shares.withColumn("blocks", F.expr(f"last_place div {SOURCES_AT_ONCE} + 1"))
    present = present.withColumn("buckets", F.ceil(2 * F.col("rows") / (F.col("blocks") * GROUP_ROWS)) + 1).withColumn("bucket", F.expr("pmod(xxhash64(term), buckets)"))
    found = key(absent).unionAll(key(present)).groupBy("lang", "a", "b", "bucket").applyInArrow(_pair_sums, "lang string, place int, other int, extra long, base long")
    found = found.groupBy("lang", "place", "other").agg(F.sum("extra").alias("extra"), F.max("base").alias("base"))
    named = groups.select("lang", "place", "source", "v")
    found = found.join(named, ["lang", "place"]).join(named.select("lang", F.col("place").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    return found.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("extra") + F.col("base") * F.col("v")).alias("value"))


def source_divergence(docs: DataFrame, least_documents: int = 3, terms_shown: int = 200) -> DataFrame:
    """How far the sources of each language differ: lang, source, part, item, value, rank.

    The share of a kept term (one that at least so many documents of its language have) in a group of N occurrences of V kept
    terms is p = 1 + floor(10^9 (count + 1) / (N + V)); two shares are floor((p - q)^2 / q) apart. Part `pair` has a row for every other source of the language,
    with the sum over all kept terms. Part `term` has the terms that the source has and that are more frequent there than in the whole language,
    at most `terms_shown` by distance. Ranks go from 1 within language, source and part, by value, then by item in byte order.

    Words are sorted in shards of texts as pointers into their bytes; a run of equal words gives the counts of each group and
    the documents. Null text, lang and source are empty strings. Empty texts count as documents of their group without terms;
    repeated rows count each; texts of any length are counted whole. A language without kept terms has pairs at 0 and no
    terms; one with a single source has no pairs. An empty table gives no rows; other columns are not looked at.
    """
    terms, groups = kept_terms(docs, least_documents)
    small = F.broadcast if groups.count() <= 100_000 else lambda df: df.hint("merge")
    sized = groups.withColumn("last_place", F.max("place").over(Window.partitionBy("lang"))).select("lang", "source", "place", "last_place", "rows", "v", F.col("n").alias("total"), F.col("lang_n").alias("lang_total"))
    shares = terms.join(small(sized), ["lang", "source"]).withColumns({"p": _share("n", "total + v"), "q": _share("lang_n", "lang_total + v")})
    special = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_DISTANCE).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    special = special.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms_shown)
    return _pairs(shares, groups).withColumn("rank", F.row_number().over(order)).unionByName(special)
