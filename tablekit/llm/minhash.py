"""Near-duplicates: universal hash minima, banding, signature verification, exact confirmation, connected components.

Copies (equal shingle sets) fold into one representative first. In each band bucket the members are linked to one centre, not
to each other, so a bucket of any size costs a row per member. Members that the stars leave in different components of a shared
bucket are then compared with each other: those of small buckets as pairs, those of large ones in blocks of bounded size, where
a task counts all intersections of two blocks and gives out links alone. Every link is confirmed on the full sets. Components
come from alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablekit.llm.arrays import NOT_SPACE, Block, blocks, mixed, words
from tablekit.llm.work import maybe_among, text_columns, without, written

#: 32 bands of 4 minima: two sets of similarity 0.8 share no band with a chance of 5e-8.
BANDS, ROWS = 32, 4
#: A pair goes to confirmation unless its signatures agree in so few minima as a similar pair does with a chance under 1e-9.
_SIGMAS = 6.0
#: Buckets of at most so many members give out their pairs (so a row gives a bounded number); larger ones are compared in
#: blocks of about so many documents and so many characters of text.
SMALL_BUCKET, BLOCK_DOCS, BLOCK_CHARS = 32, 512, 16 << 20
_COLUMNS = 1 << 13
#: A shingle held by more than this share of a family of documents is common there and stands behind all others.
COMMON_SHARE = 1 / 64
EDGES_PER_TASK = 250_000
_FACTORS = np.random.default_rng(97).integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and where each text's begin. A text of fewer words than `size`,
    but not none, has its whole word sequence as one shingle."""
    found = words(block, NOT_SPACE, fold=True)
    counts = found.counts
    value = mixed(found.hash)
    ends = np.repeat(found.first[1:], counts)
    at = np.arange(len(value))
    room = np.minimum(ends - at, size)
    keep = (room == size) | ((at == np.repeat(found.first[:-1], counts)) & (room < size))
    for step in range(1, size):
        inside = room > step
        value[inside] = mixed(value[inside] * np.uint64(0x9FB21C651E98DF25) + found.hash[at[inside] + step])
    value = value[keep]
    first = np.concatenate([[0], np.cumsum(keep)])[found.first]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        value[a:b].sort()
    fresh = np.ones(len(value), bool)
    fresh[1:] = value[1:] != value[:-1]
    fresh[first[:-1][first[1:] > first[:-1]]] = True
    return value[fresh], np.concatenate([[0], np.cumsum(fresh)])[first]


def _wrapping_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set (print_a, print_b), and the minima as bytes (null: empty set)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), 1 << 20):
                values, first = shingle_sets(block, size)
                counts = np.diff(first)
                minima = np.zeros((len(counts), len(_FACTORS)), np.uint32)
                filled, work = np.flatnonzero(counts), np.empty_like(values)
                if len(filled):
                    for k, (factor, plus) in enumerate(_FACTORS):
                        np.multiply(values, factor, out=work)
                        work += plus
                        minima[filled, k] = np.minimum.reduceat(work, first[filled]) >> np.uint64(32)
                raw = minima.tobytes()
                width = 4 * len(_FACTORS)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(block.first, block.last - block.first), "n_shingles": pa.array(counts, pa.int64()),
                    "print_a": pa.array(_wrapping_sums(mixed(values), first)), "print_b": pa.array(_wrapping_sums(mixed(values ^ np.uint64(0x5851F42D4C957F2D)), first)),
                    "minima": pa.array([raw[i * width:(i + 1) * width] if c else None for i, c in enumerate(counts.tolist())], pa.binary())})

    return (text_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
            .mapInArrow(sign, "doc_id long, n_shingles long, print_a long, print_b long, minima binary"))


def _band_rows(representatives: DataFrame) -> DataFrame:
    """(bucket, rep) for every band of every representative."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                minima = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(1)
                for k in range(ROWS):
                    key = mixed(key * np.uint64(0x9FB21C651E98DF25) + minima[:, :, k])
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(key.reshape(-1).view(np.int64)),
                                                  "rep": pa.array(np.repeat(batch.column(0).to_numpy(), BANDS), pa.int64())})

    return representatives.select("rep", "minima").mapInArrow(cut, "bucket long, rep long")


def _agreeing(pairs: DataFrame, minima: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose signatures leave a similarity of `threshold` possible."""
    n = BANDS * ROWS
    least = threshold * n - _SIGMAS * (threshold * (1 - threshold) * n) ** 0.5

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, n) for k in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((left == right).sum(1) >= least))

    own = minima.select(F.col("rep").alias("a"), F.col("minima").alias("minima_a"))
    other = minima.select(F.col("rep").alias("b"), F.col("minima").alias("minima_b"))
    return pairs.join(own, "a").join(other, "b").select("a", "b", "minima_a", "minima_b").mapInArrow(agree, "a long, b long")


def _texts_of(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """(rep, text) of the documents `ends` (rep), read from the table with nearly all other rows dropped in the scan."""
    ends = written(ends.distinct(), "ends")
    texts = text_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("rep"), "text")
    return maybe_among(texts, "rep", ends).where("_maybe").drop("_maybe").join(ends, "rep", "left_semi")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A and B| >= percent * |A or B| on their full shingle sets."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            done = 0
            for block in blocks(batch.column(2)):
                left, at = shingle_sets(block, size)
                column = batch.column(3).slice(block.first, block.last - block.first)
                for other in blocks(column, 1 << 62):
                    right, to = shingle_sets(other, size)
                    for k in range(block.last - block.first):
                        x, y = left[at[k]:at[k + 1]], right[to[k]:to[k + 1]]
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep[done + k] = bool(len(x)) and bool(len(y)) and 100 * both >= percent * (len(x) + len(y) - both)
                done = block.last
            yield batch.select([0, 1]).filter(pa.array(keep))

    own = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(own, "a").join(other, "b").select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")


def _block_links(ids: np.ndarray, components: np.ndarray, side: np.ndarray, texts: list[str], within: bool, size: int, percent: int) -> list[tuple[int, int]]:
    """Links between documents of different components of two blocks (or within one): exact intersections by products of
    incidence matrices, a slice of the shared shingles at a time."""
    sets = [shingle_sets(block, size) for block in blocks(pa.array(texts, pa.string()))]
    value = np.concatenate([v for v, _ in sets])
    length = np.concatenate([np.diff(at) for _, at in sets])
    row = np.repeat(np.arange(len(texts)), length)
    word, column, seen = np.unique(value, return_inverse=True, return_counts=True)
    place = np.cumsum(seen > 1) - 1
    shared = seen[column] > 1
    row, column = row[shared], place[column[shared]]
    left, right = (np.arange(len(texts)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    both = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int((seen > 1).sum()), _COLUMNS):
        inside = (column >= begin) & (column < begin + _COLUMNS)
        has = np.zeros((len(texts), _COLUMNS), np.float32)
        has[row[inside], column[inside] - begin] = 1
        both += has[left] @ has[right].T
    union = length[left][:, None] + length[right][None, :] - both
    link = (both > 0) & (100 * both >= percent * union) & (components[left][:, None] != components[right][None, :])
    return [(int(ids[left[i]]), int(ids[right[j]])) for i, j in zip(*np.nonzero(link)) if ids[left[i]] != ids[right[j]]]


def _families(docs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that buckets chain together are a family: rows (rep, component, family, text), and (family, members, n) with the blocks
    that its texts take."""
    least = members.groupBy("bucket").agg(F.min("rep").alias("least"))
    family = written(connected_components(members.join(least, "bucket").select(F.col("rep").alias("a"), F.col("least").alias("b"))), "families")
    named = written(members.groupBy("rep").agg(F.min("component").alias("component")).join(family.withColumnRenamed("node", "rep").withColumnRenamed("component", "family"), "rep"), "named")
    texts = _texts_of(docs, named.select("rep")).join(named, "rep")
    totals = texts.groupBy("family").agg(F.count("*").alias("members"), F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum(F.length("text")) / BLOCK_CHARS)).alias("n"))
    return texts, written(totals, "family-sizes")


def _common_shingles(texts: DataFrame, totals: DataFrame, size: int) -> DataFrame:
    """(family, shingle, held): the shingles that more than COMMON_SHARE of a family hold, at most its inverse times a mean set."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family = batch.column(0).to_numpy()
            for block in blocks(batch.column(1), 1 << 20):
                values, first = shingle_sets(block, size)
                of = np.repeat(family[block.first:block.last], np.diff(first))
                order = np.lexsort((values, of))
                values, of = values[order], of[order]
                begin = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (of[1:] != of[:-1])])) if len(values) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict({"family": pa.array(of[begin], pa.int64()), "shingle": pa.array(values[begin].view(np.int64)),
                                                  "held": pa.array(np.diff(np.append(begin, len(values))), pa.int64())})

    counted = texts.select("family", "text").mapInArrow(count, "family long, shingle long, held long")
    held = counted.groupBy("family", "shingle").agg(F.sum("held").alias("held")).where(F.col("held") > SMALL_BUCKET)
    return held.join(totals, "family").where(F.col("held") > COMMON_SHARE * F.col("members")).select("family", "shingle", "held")


def _rare_groups(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """(bucket, rep, component, n): documents of large buckets grouped by each of their least common shingles, where a group has more than one
    component. Any two that are to be linked share a group. A text is shuffled once, however large its family."""
    texts, totals = _families(docs, members)
    common = written(_common_shingles(texts, totals, size), "common")
    dealt = texts.join(totals, "family").select("family", F.pmod(F.xxhash64("rep"), F.col("n")).alias("i"), "rep", "component", "text")
    everywhere = common.join(totals, "family").select("family", F.explode(F.expr("sequence(0L, n - 1)")).alias("i"), "shingle", "held")

    def choose(key: tuple[pa.Scalar, ...], rows: pa.Table, known: pa.Table) -> pa.Table:
        common, held = known.column("shingle").to_numpy().view(np.uint64), known.column("held").to_numpy()
        common, held = common[(order := np.argsort(common))], held[order]
        chosen, source, done = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for block in blocks(rows.column("text").combine_chunks(), 1 << 20) if rows.num_rows else ():
            values, first = shingle_sets(block, size)
            at = np.searchsorted(common, values)
            at[at == len(common)] = 0
            rank = np.where(common[at] == values, held[at], 0) if len(common) else np.zeros(len(values), np.int64)
            for k, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                take = (y - x) - -(-percent * (y - x) // 100) + 1
                chosen.append(values[x:y][np.lexsort((values[x:y], rank[x:y]))[:take]])
                source.append(np.full(len(chosen[-1]), done + k))
            done += len(first) - 1
        at = np.concatenate(source)
        return pa.table({"family": pa.array(np.full(len(at), key[0].as_py()), pa.int64()), "shingle": pa.array(np.concatenate(chosen).view(np.int64)),
                         "rep": rows.column("rep").take(pa.array(at)), "component": rows.column("component").take(pa.array(at))})

    keys = ["family", "i"]
    rare = dealt.groupBy(*keys).cogroup(everywhere.groupBy(*keys)).applyInArrow(choose, "family long, shingle long, rep long, component long")
    rare = written(rare.select(F.xxhash64("family", "shingle").alias("bucket"), "rep", "component"), "rare")
    return written(_open(rare), "open-rare")


def _open(members: DataFrame) -> DataFrame:
    """The members (bucket, rep, component) of buckets with more than one component, and their number n."""
    still = members.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x < y").select("bucket", "n")
    return members.join(still, "bucket").select("bucket", "rep", "component", "n")


def _links_in_blocks(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) for all links between members (bucket, rep, component) of large groups. A family is cut into blocks by hash, and each pair of
    blocks is one group, so a document is sent once per block of its family."""
    texts, totals = _families(docs, members)
    dealt = texts.join(totals, "family").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n"))).withColumn("other", F.explode(F.expr("sequence(0L, n - 1)")))
    dealt = dealt.select("rep", "component", "text", "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        of = lambda name: rows.column(name).to_numpy()
        links = _block_links(of("rep"), of("component"), of("side"), rows.column("text").to_pylist(), key[1].as_py() == key[2].as_py(), size, percent)
        return pa.table({"a": pa.array([min(x) for x in links], pa.int64()), "b": pa.array([max(x) for x in links], pa.int64())})

    return dealt.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; component is its smallest reachable node.

    Alternating large-star and small-star: each is a minimum per node (combined before the shuffle) joined back to the node's
    links, so a node with very many links is one long key of a join, never one group in memory. Ends when a round changes
    nothing: then every node points straight at its component.
    """
    edges = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before, n = None, edges.count()
    while True:
        edges = _starred(edges, n)
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if (n, total) == before:
            return _pointers(edges)
        before = n, total


def _starred(edges: DataFrame, n: int) -> DataFrame:
    """One large-star and one small-star step over n edges (u > v). Their tasks are as many as the edges need."""
    tasks = max(4, -(-n // EDGES_PER_TASK))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    large = written(large.coalesce(tasks), "large-star")
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = (large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return written(small.coalesce(tasks), "small-star")


def _pointers(edges: DataFrame) -> DataFrame:
    """(node, component) from edges (u > v): the smallest node each points at; roots point at themselves."""
    own = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return own.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(own, "node", "left_anti"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept.

    Sets are distinct shingles of `size` words (runs of characters other than ASCII white space, A-Z lower-cased); documents
    are linked where 100 * intersection >= percent * union. Null or empty text: an empty set, linked with nothing. Rows of one
    doc_id are one document; rows without a doc_id are never linked (component_id null, kept). An empty table gives no rows.
    """
    signed = written(signatures(docs, size), "signatures")
    prints = ["print_a", "print_b"]
    sets = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(sets.groupBy(*prints).agg(F.min("doc_id").alias("rep")), "classes")
    minima = written(sets.join(classes, [*prints]).where("doc_id = rep").select("rep", "minima").groupBy("rep").agg(F.max("minima").alias("minima")), "minima")
    bands = _band_rows(minima)
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = written(bands.join(shared, "bucket"), "members")

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = written(_agreeing(pairs, minima, percent / 100), "likely")
        return _confirmed(likely, _texts_of(docs, likely.select(F.explode(F.array("a", "b")).alias("rep"))), size, percent)

    stars = members.groupBy("bucket").agg(F.min("rep").alias("a"))
    pairs = written(members.join(stars, "bucket").where("rep != a").select("a", F.col("rep").alias("b")).distinct(), "pairs")
    links = written(confirmed(pairs), "confirmed")
    # What two star steps join surely belongs together; the components themselves come last.
    sure = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    labels = written(_pointers(_starred(sure, links.count())), "labels")

    here = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    here = written(_open(here), "open")
    small = here.where(F.col("n") <= SMALL_BUCKET)
    large = here.where(F.col("n") > SMALL_BUCKET)
    crowded = None
    if not large.isEmpty():
        rare = _rare_groups(docs, large, size, percent)
        small, crowded = small.unionByName(rare.where(F.col("n") <= SMALL_BUCKET)), rare.where(F.col("n") > SMALL_BUCKET)
    small = small.select("bucket", "rep", "component")
    other = small.select("bucket", F.col("rep").alias("b"), F.col("component").alias("its"))
    rest = small.withColumnRenamed("rep", "a").join(other, "bucket").where("a < b and component != its").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    found = confirmed(written(rest, "pairs"))
    if crowded is not None and not crowded.isEmpty():
        found = found.unionByName(_links_in_blocks(docs, crowded, size, percent))
    found = written(found, "confirmed")
    labels = written(connected_components(links.unionByName(found)), "labels")

    ids = signed.select("doc_id", "n_shingles", *prints).join(classes, prints, "left")
    ids = ids.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return ids.select("doc_id", "n_shingles", F.coalesce(own, F.col("doc_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay, all columns kept: of each group the document with the smallest id."""
    gone = written(near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return without(docs, "doc_id", gone)
