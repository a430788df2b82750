"""Mixing sources to target weights: tempered token shares, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent between 0 (all sources alike) and 1 (as they are), normalised.
The exponent is bisected until the weights reach a target entropy, or as far down as a limit on repetition allows. Documents
fall into blocks by hash; the blocks of each source are put into a hash order per epoch and taken until the source's token
budget is spent, the last block document by document. Whether
a row is taken depends on it and its source's few numbers alone, so texts are never shuffled.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from tablekit.llm.work import written

#: Tokens (words) of a block, on average. A window never holds more than one source's blocks or one block's documents.
BLOCK_TOKENS = 1 << 20
#: A mixture is over a list of named origins. More than this many is an error, not a plan.
MAX_SOURCES = 100_000
_STEPS = 60


def _tempered(tokens: dict[str | None, int], exponent: float) -> dict[str | None, float]:
    total = sum(tokens.values())
    raw = {s: math.exp(exponent * math.log(n / total)) for s, n in tokens.items() if n}
    norm = sum(raw.values())
    return {s: x / norm for s, x in raw.items()}


def _entropy(weights: dict[str | None, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w)


def _budget(tokens: dict[str | None, int], weights: dict[str | None, float]) -> float:
    """The smallest budget that takes every source at least once."""
    return max((tokens[s] / w for s, w in weights.items()), default=0.0)


def bisected_exponent(tokens: dict[str | None, int], target_entropy: float | None = None, max_repeat: float | None = None,
                      budget: int | None = None) -> float:
    """The largest exponent whose weights have at least the target entropy, or else the smallest whose repetition stays within
    `max_repeat` (both: the larger of the two). Entropy falls and repetition falls as the exponent grows, so halving finds
    each. `tokens`: per source. Entropy is in nats; one beyond ln(sources) gives 0."""
    tokens = {s: n for s, n in tokens.items() if n}
    if len(tokens) < 2:
        return 1.0

    def halved(low_is_wanted) -> float:
        low, high = 0.0, 1.0
        for _ in range(_STEPS):
            middle = (low + high) / 2
            low, high = (middle, high) if low_is_wanted(middle) else (low, middle)
        return (low + high) / 2

    def repeats(exponent: float) -> float:
        weights = _tempered(tokens, exponent)
        total = budget or _budget(tokens, weights)
        return max(total * w / tokens[s] for s, w in weights.items())

    found = []
    if target_entropy is not None:
        found.append(1.0 if _entropy(_tempered(tokens, 1.0)) >= target_entropy else halved(lambda e: _entropy(_tempered(tokens, e)) >= target_entropy))
    if max_repeat is not None:
        found.append(0.0 if repeats(0.0) <= max_repeat else halved(lambda e: repeats(e) > max_repeat))
    return max(found, default=1.0)


class Plan(NamedTuple):
    """What is decided per source: a handful of numbers each. A block is taken in the last epoch if its key is below
    `block_key`; of the block with that key, documents whose key is at most `document_key` are."""

    exponent: float
    rows: list[tuple]  # source, weight, n_blocks, epochs, block_key, document_key


_PLAN = "source string, weight double, n_blocks long, epochs long, block_key long, document_key long"


def _counted(docs: DataFrame, tokens_column: str | None, seed: int) -> DataFrame:
    """`docs` with _mix_tokens, _mix_source and _mix_draw, a hash of the row's content: a lost task deals its rows out again alike."""
    n = docs[f"`{tokens_column}`"].cast("long") if tokens_column else F.regexp_count(docs["text"], F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    content = [docs["doc_id"].cast("long"), docs["source"].cast("string"), n if tokens_column else docs["text"]]
    return docs.withColumns({"_mix_tokens": F.coalesce(n, F.lit(0).cast("long")), "_mix_source": docs["source"].cast("string"), "_mix_draw": F.xxhash64(F.lit(seed), *content)})


def _block_key(seed: int):
    return F.xxhash64(F.lit(seed), F.col("epochs"), F.pmod(F.col("_mix_draw"), F.col("n_blocks")))


def _document_key():
    return F.xxhash64(F.col("epochs"), F.col("_mix_draw"))


def mixing_plan(docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = 1.5, budget: int | None = None,
                tokens_column: str | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> Plan:
    """Exponent, weights, whole epochs and the edge of the last one for every source.

    Blocks are summed before they meet; a window sees one source's blocks (a row per block), then the cut block's documents.
    """
    spark = docs.sparkSession
    counted = written(_counted(docs, tokens_column, seed).select("_mix_source", "_mix_tokens", "_mix_draw"), "counted")
    sums = counted.groupBy("_mix_source").agg(F.sum("_mix_tokens").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = {r._mix_source: int(r.n) for r in sums}
    exponent = bisected_exponent(tokens, target_entropy, max_repeat, budget)
    weights = _tempered(tokens, exponent)
    total = budget or _budget(tokens, weights)
    first = []
    for source, n in tokens.items():
        share = round(total * weights[source]) if n else 0
        epochs = share // n if n else int(not budget)
        first.append((source, float(weights.get(source, 0.0)), max(1, -(-n // block_tokens)), epochs, share - epochs * n))
    shares = spark.createDataFrame(first, "source string, weight double, n_blocks long, epochs long, rest long")
    dealt = counted.join(F.broadcast(shares), F.col("_mix_source").eqNullSafe(F.col("source")))  # at most MAX_SOURCES rows
    blocks = dealt.groupBy("source", _block_key(seed).alias("block_key")).agg(F.sum("_mix_tokens").alias("size"), F.first("rest").alias("rest"))
    before = lambda key, size: F.coalesce(F.sum(size).over(Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (blocks.withColumn("before", before("block_key", "size")).where("before < rest").groupBy("source")
           .agg(F.max("block_key").alias("block_key"), F.max("before").alias("before")))
    cuts = {r.source: r for r in cut.collect()}
    edges = spark.createDataFrame([(x[0], *x[2:], cuts[x[0]].block_key, x[4] - cuts[x[0]].before) for x in first if x[0] in cuts],
                                  "source string, n_blocks long, epochs long, rest long, block_key long, left long")
    inside = (counted.join(F.broadcast(edges), F.col("_mix_source").eqNullSafe(F.col("source"))).where((_block_key(seed) == F.col("block_key")) & (F.col("_mix_tokens") > 0))
              .groupBy("source", "left", _document_key().alias("document_key")).agg(F.sum("_mix_tokens").alias("size")))
    last = {r.source: r.document_key for r in inside.withColumn("before", before("document_key", "size")).where("before < left")
            .groupBy("source").agg(F.max("document_key").alias("document_key")).collect()}
    return Plan(exponent, [(s, w, n, e, cuts[s].block_key if s in cuts else None, last.get(s)) for s, w, n, e, _ in first])


def _with_copies(docs: DataFrame, plan: Plan, tokens_column: str | None, seed: int) -> DataFrame:
    rows = docs.sparkSession.createDataFrame(plan.rows, _PLAN)
    named = rows.select(*(F.col(c).alias(f"_plan_{c}") for c in rows.columns))
    own = _counted(docs, tokens_column, seed).join(F.broadcast(named), F.col("_mix_source").eqNullSafe(F.col("_plan_source")), "left")
    key = F.xxhash64(F.lit(seed), F.col("_plan_epochs"), F.pmod(F.col("_mix_draw"), F.col("_plan_n_blocks")))
    extra = (key < F.col("_plan_block_key")) | ((key == F.col("_plan_block_key")) & (F.xxhash64(F.col("_plan_epochs"), F.col("_mix_draw")) <= F.col("_plan_document_key")))
    return own.withColumn("_mix_copies", F.col("_plan_epochs") + F.when(extra & (F.col("_mix_tokens") > 0), 1).otherwise(0))


def mixture(docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = 1.5, budget: int | None = None,
            tokens_column: str | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """One row per row of `docs`: doc_id, source, n_tokens, weight (its source's), copies (times it is taken), exponent.

    Tokens are words (runs without ASCII white space) or `tokens_column`. Without a `budget` (in tokens) the mixture is the
    smallest that takes every document once: the source with the lowest ratio of weight to size once, others more often, up
    to `max_repeat` times their tokens. With a budget, sources beyond their share are thinned. Of a source, whole epochs are
    taken first; the rest of its budget is filled from the epoch's permutation of blocks, a document taken while the tokens
    before it are less than what is left. Null source is a source of its own; texts without tokens are taken as often as whole
    epochs go (once without a budget); equal rows are taken alike; an empty table gives no rows. The driver holds a few
    numbers per source, at most MAX_SOURCES of them.
    """
    plan = mixing_plan(docs, target_entropy, max_repeat, budget, tokens_column, block_tokens, seed)
    return _with_copies(docs, plan, tokens_column, seed).select(
        docs["doc_id"], F.col("_mix_source").alias("source"), F.col("_mix_tokens").alias("n_tokens"), F.col("_plan_weight").alias("weight"),
        F.col("_mix_copies").alias("copies"), F.lit(plan.exponent).alias("exponent"))


def mixed_documents(docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = 1.5, budget: int | None = None,
                    tokens_column: str | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """The rows of `docs`, each as often as `mixture` takes it, all columns kept, without a shuffle of the texts."""
    plan = mixing_plan(docs, target_entropy, max_repeat, budget, tokens_column, block_tokens, seed)
    own = _with_copies(docs, plan, tokens_column, seed)
    own = own.withColumn("_mix_copy", F.explode(F.expr("case when _mix_copies > 0 then sequence(1, cast(_mix_copies as int)) end")))
    return own.select(*(docs[f"`{c}`"] for c in docs.columns))
