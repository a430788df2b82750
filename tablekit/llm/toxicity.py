"""Toxicity by a classifier chain: a linear model per category, later ones fed the probabilities of earlier ones."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablekit.llm.arrays import ALPHANUMERIC, Block, blocks, sums, words
from tablekit.llm.linear import Model, fit_logistic, sigmoid
from tablekit.llm.minhash import shingle_sets
from tablekit.llm.work import text_columns

#: Labelled rows that the models are fitted on, at most (those of smallest hash), and folds for out-of-fold probabilities.
SAMPLE_ROWS, FOLDS = 16_000, 4
#: A word becomes a feature if it is in at least so many sampled texts and its chi-squared statistic with a category is beyond
#: the bound (a chance of 1e-8 for one word), so that the sum over a long text is not noise.
_LEAST_TEXTS, _CHI2 = 8, 33.0
_MAX_WORDS = 1000
_SKETCH = 3
_DENSE = 4
_codes = np.arange(256)
_UPPER, _PUNCTUATION = (_codes >= 65) & (_codes <= 90), (_codes > 32) & (_codes < 127) & ~ALPHANUMERIC


def _features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, word) pairs of a block and the dense columns of each text: shares of punctuation and capitals, the
    logarithm of the word count, the share of words that repeat an earlier one."""
    found = words(block, ALPHANUMERIC, fold=True)
    text = found.text
    order = np.lexsort((found.hash, text))
    text, word = text[order], found.hash[order]
    fresh = np.ones(len(word), bool)
    fresh[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
    counts, size = found.counts, np.maximum(np.diff(block.offsets), 1)
    distinct = sums(fresh, found.first)
    dense = np.stack([sums(_PUNCTUATION[block.data], block.offsets) / size, sums(_UPPER[block.data], block.offsets) / size,
                      np.log1p(counts) / 10, 1 - distinct / np.maximum(counts, 1)], 1)
    return text[fresh], word[fresh], dense


class Chain(NamedTuple):
    categories: list[str]
    vocabulary: np.ndarray  # sorted hashes of the words that are features
    models: list[Model]

    def probabilities(self, present: np.ndarray, dense: np.ndarray) -> np.ndarray:
        out = np.zeros((len(dense), 0))
        for model in self.models:
            out = np.hstack([out, sigmoid(model.margins(np.hstack([present, dense, out])))])
        return out


def _sample(docs: DataFrame, labels: DataFrame, categories: dict[str, str], rows: int) -> list:
    named = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.expr(sql).cast("int")).alias(f"y{i}") for i, sql in enumerate(categories.values())))
    named = named.where(" and ".join(f"y{i} is not null" for i in range(len(categories)))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = text_columns(docs, "doc_id", "text").join(F.broadcast(named), "doc_id")  # at most `rows` rows of a few numbers
    outputs = [f"y{i}" for i in range(len(categories))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                text, word, dense = _features(block)
                at = np.searchsorted(text, np.arange(block.last - block.first + 1))
                pairs, first = shingle_sets(block, 2)
                sketch = [pairs[a:min(b, a + _SKETCH)].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                part = batch.slice(block.first, block.last - block.first)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0), "words": pa.array([word[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()),
                    "sketch": pa.array(sketch, pa.binary()), "dense": pa.array([x.tobytes() for x in dense], pa.binary()), **{y: part.column(2 + i) for i, y in enumerate(outputs)}})

    shape = "doc_id long, words binary, sketch binary, dense binary, " + ", ".join(f"{y} int" for y in outputs)
    found = joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *outputs).mapInArrow(cut, shape).collect()
    # Near copies count once: texts with the same smallest hashes of word pairs. Order and choice don't depend on the partitions.
    kept: dict[bytes, object] = {}
    for row in sorted(found, key=lambda r: (r.doc_id, bytes(r.words))):
        kept.setdefault(bytes(row.sketch), row)
    return list(kept.values())


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS) -> Chain:
    """Fit on at most `sample_rows` labelled documents. categories: name to SQL over `labels` (0 or 1), in chain order.

    A later model is trained on out-of-fold probabilities of the earlier categories: those that models fitted on the other
    folds give, so it learns how far they can be trusted on unseen texts.
    """
    rows = _sample(docs, labels, categories, sample_rows)
    labelled = np.array([[r[f"y{i}"] for i in range(len(categories))] for r in rows], float).reshape(len(rows), len(categories))
    dense = np.array([np.frombuffer(r.dense) for r in rows], np.float32).reshape(len(rows), _DENSE)
    hashes = [np.frombuffer(r.words, np.uint64) for r in rows]
    vocabulary = np.zeros(0, np.uint64)
    if rows:
        word, which = np.unique(np.concatenate(hashes), return_inverse=True)
        which, text = which.astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), [len(h) for h in hashes])
        seen = np.bincount(which, minlength=len(word)).astype(float)
        best = np.zeros(len(word))
        for y in labelled.T:
            inside, share = np.bincount(which, y[text], len(word)), y.mean()
            spread = seen * share * (1 - share) * (1 - seen / len(rows))
            best = np.maximum(best, np.where(spread > 0, (inside - seen * share) ** 2 / np.maximum(spread, 1e-9), 0.0))
        good = np.flatnonzero((seen >= _LEAST_TEXTS) & (best > _CHI2))
        vocabulary = np.sort(word[good[np.argsort(-best[good], kind="stable")[:_MAX_WORDS]]])
        del which, text, word
    present = np.array([np.isin(vocabulary, h, kind="sort") for h in hashes], np.float32).reshape(len(rows), len(vocabulary))
    fold = np.array([(r.doc_id * 2654435761 >> 8) % folds for r in rows])
    del rows, hashes
    x, models = np.hstack([present, dense]), []
    del present
    for y in labelled.T:
        models.append(fit_logistic(x, y[:, None]))
        outside = np.zeros((len(x), 1), np.float32)
        for k in range(folds):
            if (fold == k).any():
                outside[fold == k] = sigmoid(fit_logistic(x[fold != k], y[fold != k, None]).margins(x[fold == k]))
        x = np.hstack([x, outside])
    return Chain(list(categories), vocabulary, models)


def predict_chain(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id and, for each category, p_<name> (probability) and is_<name> (at least `threshold`), of every whole text.

    Null or empty text has no features: its probabilities are the models' biases. Rows are judged one by one.
    """
    shape = "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.categories)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                text, word, dense = _features(block)
                present = np.zeros((len(dense), len(chain.vocabulary)))
                if len(chain.vocabulary) and len(word):
                    at = np.minimum(np.searchsorted(chain.vocabulary, word), len(chain.vocabulary) - 1)
                    hit = chain.vocabulary[at] == word
                    present[text[hit], at[hit]] = 1
                p = chain.probabilities(present, dense)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(block.first, block.last - block.first),
                                                  **{f"p_{c}": pa.array(p[:, i]) for i, c in enumerate(chain.categories)}})

    found = text_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(predict, shape)
    return found.withColumns({f"is_{c}": F.col(f"p_{c}") >= threshold for c in chain.categories})
