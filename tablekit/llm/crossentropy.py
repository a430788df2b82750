"""Cross-entropy difference: each document's loss per token under a target model less that under a background model."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tablekit.llm.arrays import ALPHANUMERIC, Block, Words, blocks, mixed, words
from tablekit.llm.work import maybe_among, text_columns, written

#: Weight of the word model within the pair model, and of the uniform one within the word model, in tokens of the target.
_PAIR_PRIOR, _WORD_PRIOR = 4.0, 0.05
#: Words that make up more than one in HOT_WORDS tokens, and pairs that make up more than two in HOT_PAIRS, are looked up where
#: they are met; no key that is shuffled has more than this share. HOT_PAIRS is at most HOT_WORDS: a hot pair's word is hot.
HOT_WORDS, HOT_PAIRS = 1 << 16, 1 << 12
#: Tokens a bucket of the shuffle has on average, and entries a task holds before it sends them.
BUCKET_TOKENS, HELD_ENTRIES = 3 << 19, 1 << 19
#: Rows whose sums travel back together.
GROUP_ROWS = 1 << 13
_BEGIN = np.uint64(0x1D8E4E27C47D124F)
_ROWS = "row long, place int, doc_id long, n_tokens long, target double, background double"


class Sizes(NamedTuple):
    """Tokens of both models, the factors that make them weigh alike, and the number of different words."""

    tokens: tuple[int, int]
    scale: tuple[float, float]
    vocabulary: int

    def prior(self, counts: np.ndarray, model: int) -> np.ndarray:
        """What the word model adds to a pair's count, from the count of its word."""
        word = (counts * self.scale[model] + _WORD_PRIOR) / (self.tokens[model] * self.scale[model] + _WORD_PRIOR * self.vocabulary)
        return _PAIR_PRIOR * word


def _paired(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(context * np.uint64(0x9FB21C651E98DF25) + word)


def _at(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One value for a key within a text."""
    return key + mixed(text.astype(np.uint64))


def _tokens(block: Block) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of a block; for each the hash of the word before it (or the text's beginning), and that of both."""
    found = words(block, ALPHANUMERIC, fold=True)
    before = np.empty_like(found.hash)
    before[1:] = found.hash[:-1]
    before[found.first[:-1][found.counts > 0]] = _BEGIN
    return found, before, _paired(before, found.hash)


def _marked(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, text, inside: whether the id is in `target_ids`. Only texts that may be the target's are moved to find out, in a
    shuffled join at every size, since the target grows with the corpus; they are written, so that rows keep their places."""
    texts = text_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = written(target_ids.select(F.col(target_ids.columns[0]).alias("_id")).where("_id is not null").distinct(), "target")
    marked = maybe_among(texts, "doc_id", wanted)
    found = marked.where("_maybe").join(wanted.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
    found = written(found.select("doc_id", "text", F.col("_id").isNotNull().alias("inside")), "target-texts")
    return marked.where(~F.col("_maybe")).select("doc_id", "text", F.lit(False).alias("inside")).unionAll(found)


def _inside(batch: pa.RecordBatch, block: Block) -> np.ndarray:
    return batch.column(2).to_numpy(zero_copy_only=False)[block.first:block.last].astype(bool)


def count_words(texts: DataFrame) -> DataFrame:
    """is_pair, key, target, background, before_target, before_background: exact counts of every word, and of it as the one
    before, in a written table that grows with the corpus; and the pairs that are frequent in a block, counted there."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found, before, pair = _tokens(block)
                m, own = len(pair), _inside(batch, block)[found.text]
                key, at = np.unique(np.concatenate([found.hash, before]), return_inverse=True)
                sides = [np.bincount(part[side], minlength=len(key)) for part in (at[:m], at[m:]) for side in (own, ~own)]
                frequent, n = np.unique(pair, return_counts=True)
                frequent, n = frequent[n * HOT_PAIRS >= m], n[n * HOT_PAIRS >= m]
                none = np.zeros(len(n), np.int64)
                names = ("target", "background", "before_target", "before_background")
                yield pa.RecordBatch.from_pydict({
                    "is_pair": pa.array(np.arange(len(key) + len(n)) >= len(key)), "key": pa.array(np.concatenate([key, frequent]).view(np.int64)),
                    **{x: pa.array(np.concatenate([a, b]), pa.int64()) for x, a, b in zip(names, sides, (n, none, none, none))}})

    names = ("target", "background", "before_target", "before_background")
    rows = texts.mapInArrow(count, "is_pair boolean, key long, " + ", ".join(f"{x} long" for x in names))
    return written(rows.groupBy("is_pair", "key").agg(*(F.sum(x).alias(x) for x in names)), "words")


def _columns(table: DataFrame) -> list[np.ndarray]:
    """The columns of a table of bounded size, by its first one, which is read as unsigned."""
    found = table.toArrow()
    columns = [c.to_numpy() for c in found.columns]
    order = np.argsort(columns[0].view(np.uint64))
    return [columns[0].view(np.uint64)[order], *(c[order] for c in columns[1:])]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands among the sorted `keys`, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _hot_pairs(texts: DataFrame, candidates: np.ndarray) -> list[np.ndarray]:
    """pair, word, target, background of at most HOT_PAIRS pairs, counted over all texts."""
    if not len(candidates):
        return [np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found, _, pair = _tokens(block)
                at, held = _found(candidates, pair)
                key, first, back = np.unique(pair[held], return_index=True, return_inverse=True)
                own = _inside(batch, block)[found.text[held]]
                yield pa.RecordBatch.from_pydict({
                    "pair": pa.array(key.view(np.int64)), "word": pa.array(found.hash[held][first].view(np.int64)),
                    **{x: pa.array(np.bincount(back[side], minlength=len(key)), pa.int64()) for x, side in (("target", own), ("background", ~own))}})

    rows = texts.mapInArrow(count, "pair long, word long, target long, background long")
    return _columns(rows.groupBy("pair", "word").agg(F.sum("target").alias("target"), F.sum("background").alias("background")))


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of equal length, byte by byte of their values (equal high bytes then stand together), compressed."""
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)
    return pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpacked(data: bytes, n: int, types: list[type]) -> list[np.ndarray]:
    widths = [np.dtype(t).itemsize for t in types]
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, n * sum(widths)), np.uint8)
    cuts = np.cumsum([0, *widths]) * n
    return [np.ascontiguousarray(planes[a:b].reshape(w, n).T).view(t).ravel() for a, b, w, t in zip(cuts, cuts[1:], widths, types)]


def _types(kind: int, per_token: bool) -> list[type]:
    """Of an entry: the word before and the word (hot ones by rank: 1 and 2 in `kind` tell which), row in its partition, four
    times the uses plus 2 if the text ends with it plus 1 if inside, place."""
    return [np.uint32 if kind & 1 else np.uint64, np.uint32 if kind & 2 else np.uint64, np.uint32, np.uint32, *[np.uint32] * per_token]


def _by_key(key: np.ndarray, n: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the uses of its key inside and outside of the target."""
    if not len(key):
        return n, n
    order = np.argsort(key)
    starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    lengths = np.diff(np.append(starts, len(key)))
    out = []
    for side in (own, ~own):
        each = np.empty(len(key), np.int64)
        each[order] = np.repeat(np.add.reduceat(np.where(side, n, 0)[order], starts), lengths)
        out.append(each)
    return out[0], out[1]


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, per_token: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss (nats per token), difference (less is more like
    the target); with `per_token`, also the difference at each token.

    Tokens are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; every token is predicted from the one
    before it. Null or empty text has no tokens, and null losses. Rows are judged one by one, repeated or not; a document
    without an id is background; without target or background documents the empty model is uniform. `docs` must give the same
    rows in the same partitions each time it is read, as files do.

    Each use of a pair by a text goes to the bucket of its word (of the pair, where the word is hot), as part of an array.
    There it meets all other uses, so the bucket knows the exact counts of pairs and words and sends each text its sum, in
    arrays again. A word that is not hot has all its uses in its bucket, so they also tell how often it is the one before.
    """
    texts = _marked(docs, target_ids)
    met = count_words(texts)
    single = met.where("not is_pair")
    row = single.agg(F.count_if(F.expr("target + background > 0")).alias("v"), F.coalesce(F.sum("target"), F.lit(0)).alias("t"), F.coalesce(F.sum("background"), F.lit(0)).alias("b")).first()
    total, least = row.t + row.b, min((n for n in (row.t, row.b) if n), default=0)
    sizes = Sizes((row.t, row.b), (least / max(row.t, 1), least / max(row.b, 1)), max(row.v, 1))
    hot = single.where((F.col("target") + F.col("background") > total / HOT_WORDS) | (F.col("before_target") + F.col("before_background") > total / HOT_WORDS) | (F.col("key") == int(_BEGIN.view(np.int64)))).drop("is_pair")
    hot = _columns(hot)  # at most 2 * HOT_WORDS + 1 rows of 40 bytes
    pairs = _hot_pairs(texts, _columns(met.where(F.col("is_pair") & (F.col("target") > total / HOT_PAIRS)).select("key"))[0])
    of_word = _found(hot[0], pairs[1].view(np.uint64))[0]
    contexts = [np.log(hot[3 + m] * sizes.scale[m] + _PAIR_PRIOR) for m in (0, 1)]
    priors = [sizes.prior(hot[1 + m], m) for m in (0, 1)]
    losses = [-np.log(pairs[2 + m] * sizes.scale[m] + priors[m][of_word]) for m in (0, 1)]
    by_rank = np.argsort(-(hot[1] + hot[2]), kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((hot[0], by_rank, contexts, priors, pairs[0], losses))
    buckets = 8 + total // BUCKET_TOKENS

    def uses(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key of each text an index where it stands, and how often it does; every token with `per_token`."""
        if per_token:
            return np.arange(len(key)), np.ones(len(key), np.int64)
        both = _at(text, key)
        order = np.argsort(both)
        start = np.flatnonzero(np.append(True, both[order][1:] != both[order][:-1])) if len(key) else np.zeros(0, np.int64)
        return order[start], np.diff(np.append(start, len(key)))

    def result(row: np.ndarray, place: np.ndarray | None, values: list[np.ndarray]) -> dict[str, pa.Array]:
        n = len(row)
        return {"row": pa.array(row, pa.int64()), "place": pa.nulls(n, pa.int32()) if place is None else pa.array(place, pa.int32()), "doc_id": pa.nulls(n, pa.int64()),
                "n_tokens": pa.nulls(n, pa.int64()), "target": pa.array(values[0], pa.float64()), "background": pa.array(values[1], pa.float64())}

    def batch_of(columns: dict[str, pa.Array], bucket: np.ndarray, kind: list[int] | None = None, n: list[int] | None = None, data: list[bytes] | None = None) -> pa.RecordBatch:
        size = len(bucket)
        return pa.RecordBatch.from_pydict({**columns, "bucket": pa.array(bucket, pa.int32()), "kind": pa.array(kind or [None] * size, pa.int32()),
                                           "n": pa.array(n or [None] * size, pa.int32()), "data": pa.array(data or [None] * size, pa.binary())})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a text with the sums of what is known here, and arrays of entries for each bucket."""
        keys, by_rank, contexts, _, known, losses = shared.value
        rank = np.empty(len(keys), np.uint32)
        rank[by_rank] = np.arange(len(keys))
        part, row, held, n_held = TaskContext.get().partitionId() << 40, 0, defaultdict(list), 0

        def sent() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                bucket, *arrays = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(bucket, kind="stable")
                bucket, arrays = bucket[order], [a[order] for a in arrays]
                start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
                ends = np.append(start[1:], len(bucket))
                for i in range(0, len(start), 64):
                    some = [*zip(start[i:i + 64], ends[i:i + 64])]
                    none = {x: pa.nulls(len(some), t) for x, t in (("place", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target", pa.float64()), ("background", pa.float64()))}
                    yield batch_of({"row": pa.array([part] * len(some), pa.int64()), **none}, bucket[start[i:i + 64]], [kind] * len(some), [int(b - a) for a, b in some],
                                   [_packed([x[a:b] for x in arrays]) for a, b in some])
            held.clear()

        for batch in batches:
            for block in blocks(batch.column(1)):
                found, before, pair = _tokens(block)
                size, text, own = block.last - block.first, found.text, _inside(batch, block)
                place = np.arange(len(text)) - found.first[:-1][text]
                last = np.zeros(len(text), bool)
                last[found.first[1:][found.counts > 0] - 1] = True
                sums = [np.zeros(size), np.zeros(size)]
                for key, table, losses_of in ((before, keys, contexts), (pair, known, losses)):
                    i, n = uses(text, key)
                    at, here = _found(table, key[i])
                    values = [n[here] * v[at[here]] for v in losses_of]
                    if per_token and here.any():
                        rows = part + row + text[i][here]
                        yield batch_of(result(rows, place[i][here], values), -1 - rows % buckets)
                    elif here.any():
                        sums = [s + np.bincount(text[i][here], weights=v, minlength=size) for s, v in zip(sums, values)]
                i, n = i[~here], n[~here]  # of the pairs
                ends = last[i] if per_token else np.zeros(len(i), bool)
                if not per_token:
                    ends[np.flatnonzero(np.isin(_at(text[i], pair[i]), _at(text[last], pair[last])))] = True
                sides = [_found(keys, x[i]) for x in (before, found.hash)]
                code = (n * 4 + ends * 2 + own[text[i]]).astype(np.uint32)
                bucket = (mixed(np.where(sides[1][1], pair[i], found.hash[i])) % np.uint64(buckets)).astype(np.int32)
                kinds = sides[0][1] + 2 * sides[1][1]
                for kind in range(4):
                    j = np.flatnonzero(kinds == kind)
                    names = [rank[at[j]] if kind >> side & 1 else x[i[j]] for side, (x, (at, _)) in enumerate(zip((before, found.hash), sides))]
                    if len(j):
                        held[kind].append((bucket[j], *names, (row + text[i[j]]).astype(np.uint32), code[j], *[place[i[j]].astype(np.uint32)] * per_token))
                n_held += len(i)
                rows = part + row + np.arange(size)
                whole = result(rows, None, sums)
                yield batch_of({**whole, "doc_id": batch.column(0).slice(block.first, size).cast(pa.int64()), "n_tokens": pa.array(found.counts, pa.int64())}, -1 - rows % buckets)
                row += size
                if n_held >= HELD_ENTRIES:
                    yield from sent()
                    n_held = 0
        yield from sent()

    def going(columns: dict[str, pa.Array], n: list[int] | None = None, data: list[bytes] | None = None) -> pa.RecordBatch:
        size = len(columns["row"])
        group = columns["row"].to_numpy(zero_copy_only=False) // GROUP_ROWS
        return pa.RecordBatch.from_pydict({**columns, "group": pa.array(group, pa.int64()), "n": pa.array(n or [None] * size, pa.int32()), "data": pa.array(data or [None] * size, pa.binary())})

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows go on as they are; the entries of each bucket become sums of their rows."""
        keys, by_rank, _, priors, _, _ = shared.value
        names = [x.split()[0] for x in _ROWS.split(", ")]
        waiting = defaultdict(list)
        for batch in batches:
            data = batch.column("data")
            ready = data.is_null()
            yield going({x: batch.column(x).filter(ready) for x in names})
            rest = batch.filter(data.is_valid())
            for part, bucket, *packed in zip(*(rest.column(c).to_pylist() for c in ("row", "bucket", "kind", "n", "data"))):
                waiting[bucket].append((part, *packed))
        for bucket in list(waiting):
            entries = []
            for part, kind, n, x in waiting.pop(bucket):
                context, word, row, code, *place = _unpacked(x, n, _types(kind, per_token))
                at = by_rank[word] if kind & 2 else np.full(n, -1)
                entries.append((keys[by_rank[context]] if kind & 1 else context, keys[at] if kind & 2 else word, at, part + row.astype(np.int64), code, *place))
            context, word, at, rows, code, *place = (np.concatenate(c) for c in zip(*entries))
            del entries
            n, ends, own, cold = (code >> 2).astype(np.int64), (code & 2) > 0, (code & 1) > 0, at < 0
            pairs = _by_key(_paired(context, word), n, own)
            words_of, goes_on = (_by_key(word[cold], uses[cold], own[cold]) for uses in (n, n - ends))
            values, after = [], []
            for m in (0, 1):
                prior = priors[m][at] if len(keys) else np.zeros(len(at))
                prior[cold] = sizes.prior(words_of[m], m)
                values.append(-n * np.log(pairs[m] * sizes.scale[m] + prior))
                after.append(np.zeros(len(at)))
                after[m][cold] = (n - ends)[cold] * np.log(goes_on[m] * sizes.scale[m] + _PAIR_PRIOR)
            if per_token:
                more = cold & ~ends
                rows, place = np.concatenate([rows, rows[more]]), np.concatenate([place[0], place[0][more] + 1])
                values = [np.concatenate([v, a[more]]) for v, a in zip(values, after)]
                for i in range(0, len(rows), 1 << 16):
                    j = slice(i, i + (1 << 16))
                    yield going(result(rows[j], place[j], [v[j] for v in values]))
            else:
                rows, back = np.unique(rows, return_inverse=True)
                values = [np.bincount(back, weights=v + a) for v, a in zip(values, after)]
                cuts = [*np.flatnonzero(np.append(True, rows[1:] // GROUP_ROWS != rows[:-1] // GROUP_ROWS)), len(rows)]
                parts = [_packed([(rows[i:j] % GROUP_ROWS).astype(np.uint16), *(v[i:j] for v in values)]) for i, j in zip(cuts, cuts[1:])]
                empty = np.full(len(parts), np.nan)
                yield going(result(rows[cuts[:-1]], None, [empty, empty]), np.diff(cuts).tolist(), parts)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of each row of the groups dealt here."""
        totals = defaultdict(lambda: [np.zeros(GROUP_ROWS), np.zeros(GROUP_ROWS)])
        texts_of = defaultdict(list)
        for batch in batches:
            data = batch.column("data")
            for group, n, x in zip(*(batch.column(c).filter(data.is_valid()).to_pylist() for c in ("group", "n", "data"))):
                place, *values = _unpacked(x, n, [np.uint16, np.float64, np.float64])
                for whole, v in zip(totals[group], values):
                    whole[place] += v
            rows = batch.filter(data.is_null())
            group = rows.column("group").to_numpy()
            for g in np.unique(group):
                own = rows.filter(pa.array(group == g))
                for whole, name in zip(totals[g], ("target", "background")):
                    whole[own.column("row").to_numpy() % GROUP_ROWS] += own.column(name).to_numpy()
                texts_of[g].append(own.select(["row", "doc_id", "n_tokens"]))
        for g in list(texts_of):
            own = pa.Table.from_batches(texts_of.pop(g)).combine_chunks()
            target, background = (x[own.column("row").to_numpy() % GROUP_ROWS] for x in totals.pop(g))
            yield from own.drop_columns("row").append_column("t", pa.array(target)).append_column("b", pa.array(background)).to_batches()

    parts = texts.mapInArrow(spread, f"{_ROWS}, bucket int, kind int, n int, data binary").repartition(int(buckets), "bucket").mapInArrow(settled, f"{_ROWS}, group long, n int, data binary")
    if per_token:
        out = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("target").alias("t"), F.sum("background").alias("b"))
        each = parts.where("place is not null").groupBy("row", "place").agg(F.sum(F.col("target") - F.col("background")).cast("float").alias("x"))
        each = each.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda e: e.x).alias("token_differences"))
        out = out.join(each, "row", "left").withColumn("token_differences", F.coalesce("token_differences", F.array().cast("array<float>")))
    else:
        out = parts.repartition(int(buckets), "group").mapInArrow(summed, "doc_id long, n_tokens long, t double, b double")
    mean = lambda c: F.when(F.col("n_tokens") > 0, c / F.col("n_tokens"))
    return out.select("doc_id", "n_tokens", mean(F.col("t")).alias("target_loss"), mean(F.col("b")).alias("background_loss"), mean(F.col("t") - F.col("b")).alias("difference"),
                      *["token_differences"] * per_token)
