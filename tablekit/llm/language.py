"""Language identification by error-correcting output codes over hashed character n-grams of words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablekit.llm.arrays import Block, blocks, words
from tablekit.llm.linear import Model, fit_logistic
from tablekit.llm.work import text_columns

#: Rows that the classifiers are fitted on: at most so many a language, and altogether.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 300, 4000
#: Hashed n-grams (2^13), of 1 to 3 bytes within a word and its edges.
_WIDTH, _ORDERS = 1 << 13, (1, 2, 3)
#: Up to this many languages every split of them is a bit; beyond it, the best of some random codes of 10 log2 bits.
_EXHAUSTIVE = 6
#: Margin between the two best codewords, in weighted loss, below which a prediction is flagged as ambiguous.
AMBIGUOUS = 0.15
_codes = np.arange(256)
_LETTER = (_codes >= 128) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122))
_LOWER = _codes.astype(np.uint8)
_LOWER[65:91] += 32


def _word_grams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a block as n-gram numbers: (feature, first feature of each word), and for all words in a row
    (which distinct word, first word of each text)."""
    found = words(block, _LETTER, fold=True)
    if not len(found.hash):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), found.first
    _, one, which = np.unique(found.hash, return_index=True, return_inverse=True)
    start, end = found.start[one], found.end[one]
    size = end - start + 2  # with a blank on either side
    ends = np.cumsum(size)
    at = np.arange(ends[-1]) - np.repeat(ends - size, size) - 1 + np.repeat(start, size)
    data = np.full(len(at), 32, np.uint64)
    inner = np.ones(len(at), bool)
    inner[ends - 1] = inner[ends - size] = False
    data[inner] = _LOWER[block.data[at[inner]]]
    left = np.repeat(ends, size) - np.arange(len(at))  # bytes from here to the padded word's end
    features, owners = [], []
    owner = np.repeat(np.arange(len(one)), size)
    code = np.zeros(len(at), np.uint64)
    for n in range(1, max(_ORDERS) + 1):
        shifted = np.zeros(len(at), np.uint64)
        shifted[:len(at) - n + 1] = data[n - 1:]
        code = code * np.uint64(257) + shifted + np.uint64(1)
        if n in _ORDERS:
            inside = left >= n
            features.append((code[inside] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 13)).astype(np.int64))
            owners.append(owner[inside])
    feature, owner = np.concatenate(features), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return feature[order], np.searchsorted(owner[order], np.arange(len(one) + 1)), which, found.first


class Coder(NamedTuple):
    languages: list[str]
    codewords: np.ndarray  # a row of +1 and -1 for each language
    model: Model
    reliability: np.ndarray  # weight of each bit: how much better than chance it is on rows it was not fitted on


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of n languages. Few: all splits into two sides. Many: of 200 random codes the one whose closest rows are
    farthest apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= _EXHAUSTIVE:
        bits = np.arange(1, 1 << (n - 1))
        return np.where(bits[None, :] >> np.arange(n)[:, None] & 1, 1.0, -1.0)
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, length))
        if (np.abs(code.sum(0)) == n).any():
            continue
        distance = (length - code @ code.T) / 2 + length * np.eye(n)
        if distance.min() > apart:
            best, apart = code, distance.min()
    return best


def _sample(docs: DataFrame, use: Column, per_language: int, total: int) -> list:
    own = text_columns(docs, "doc_id", "lang", "text").where(use & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    each = max(1, min(per_language, total // len(counts)))
    # The share of each language whose hash is smallest; a fifth more than wanted, then cut to the bound in hash order.
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    limit = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(int(min(1.0, 1.2 * each / n) * (1 << 30)))) for lang, n in counts.items()))
    picked = own.withColumn("key", key).where(F.col("key") <= limit)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                part = batch.slice(block.first, block.last - block.first)
                rows = (row.astype(np.float16) for some in _histograms(block) for row in some)
                yield pa.RecordBatch.from_pydict({"lang": part.column(0), "key": part.column(1), "grams": pa.array([x.tobytes() for x in rows], pa.binary())})

    found = picked.select("lang", "key", "text").mapInArrow(grams, "lang string, key long, grams binary").collect()
    kept: dict[str, list] = {}
    for row in sorted(found, key=lambda r: (r.lang, r.key, bytes(r.grams))):
        kept.setdefault(row.lang, []).append(row)
    return [row for rows in kept.values() for row in rows[:each]]


def _histograms(block: Block, texts: int = 256) -> Iterator[np.ndarray]:
    """The root shares of n-grams in each text, for so many texts at a time."""
    feature, first, which, text_first = _word_grams(block)
    n = len(text_first) - 1
    for begin in range(0, n, texts):
        out = np.zeros((min(texts, n - begin), _WIDTH), np.float32)
        for k in range(len(out)):
            word, count = np.unique(which[text_first[begin + k]:text_first[begin + k + 1]], return_counts=True)
            sizes = first[word + 1] - first[word]
            ends = np.cumsum(sizes)
            if len(ends) and ends[-1]:
                at = np.repeat(first[word] - (ends - sizes), sizes) + np.arange(ends[-1])
                total = np.bincount(feature[at], np.repeat(count, sizes), _WIDTH)
                out[k] = np.sqrt(total / total.sum())
        yield out


def fit_coder(docs: DataFrame, use: Column, per_language: int = SAMPLE_PER_LANGUAGE, total: int = SAMPLE_ROWS) -> Coder:
    """Fit a classifier per code bit on at most `per_language` rows of each language (and `total` in all) that satisfy `use`.

    The languages are all values of `lang` in those rows of the table. Bits are weighed by how often they are right on a
    third of the sample that they were not fitted on.
    """
    rows = _sample(docs, use, per_language, total)
    languages = sorted({r.lang for r in rows})
    code = codebook(len(languages))
    x = np.array([np.frombuffer(r.grams, np.float16) for r in rows], np.float32).reshape(len(rows), _WIDTH)
    which = np.array([languages.index(r.lang) for r in rows], int)
    y = (code[which] > 0).astype(float) if len(rows) else np.zeros((0, code.shape[1]))
    right = np.zeros(y.shape[1])
    fold = np.arange(len(rows)) % 3
    if len(rows) >= 3:
        margins = fit_logistic(x[fold != 0], y[fold != 0], rounds=60).margins(x[fold == 0])
        right = ((margins > 0) == (y[fold == 0] > 0)).mean(0)
    weight = np.maximum(2 * right - 1, 0.01)
    return Coder(languages, code, fit_logistic(x, y, rounds=60), weight / weight.sum())


def predict_language(docs: DataFrame, coder: Coder, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous, of every whole text.

    Each bit's margin m costs a codeword ln(1 + exp(-m c)) where its bit is c, weighted by the bit's reliability; the codeword
    of least loss wins. `score` is its share of exp(-loss) over all codewords; `ambiguous` says that the
    runner-up is within the margin. Null text or text without a letter is `und` with score 0; so is any text if nothing was
    learned. Rows are judged one by one.
    """
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = coder.model.weights.astype(np.float32)
        for batch in batches:
            letter = batch.column(2).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                n = block.last - block.first
                known = letter[block.first:block.last] & (len(coder.languages) > 0)
                pred, score, close = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
                if coder.languages:
                    margins = _margins(block, weights) + coder.model.bias
                    # A text of letters outside the learned n-grams still gets the least loss.
                    cost = np.logaddexp(0, -margins[:, None, :] * coder.codewords[None]) @ coder.reliability
                    order = np.argsort(cost, axis=1, kind="stable")
                    best = order[:, 0]
                    share = np.exp(cost.min(1, keepdims=True) - cost)
                    score = np.where(known, 1 / share.sum(1), 0.0)
                    if len(coder.languages) > 1:
                        close = known & (cost[np.arange(n), order[:, 1]] - cost[np.arange(n), best] < ambiguous)
                    pred[known] = np.array(coder.languages, object)[best[known]]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(block.first, n), "lang_pred": pa.array(pred, pa.string()),
                                                  "score": pa.array(score, pa.float64()), "ambiguous": pa.array(close)})

    own = text_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return own.mapInArrow(predict, "doc_id long, lang_pred string, score double, ambiguous boolean")


def _margins(block: Block, weights: np.ndarray) -> np.ndarray:
    return np.concatenate([x @ weights for x in _histograms(block)])
