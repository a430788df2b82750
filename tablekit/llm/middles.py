"""Fill-in-the-middle: texts cut into units at two places and reordered, so that a model learns to fill a gap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from tablekit.llm.arrays import blocks
from tablekit.llm.work import text_columns

#: One line with its break, or what is left after the last break.
LINES = r"[^\n]*\n|[^\n]+"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_SHAPE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2^32 that depend on the seed and the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def fill_in_middle(docs: DataFrame, unit: str = LINES, fim_percent: int = 100, spm_percent: int = 50, seed: int = 7, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output.

    A text is matched once, as a repetition of `unit`; the ends of all repetitions give n and both cuts. The id and the seed draw the two
    cuts (of n + 1 places each), whether the text is cut (`fim_percent`) and the order (`spm_percent`: suffix first). Forms:
    psm is mark 1, prefix, mark 2, suffix, mark 3, middle; spm is mark 2, suffix, mark 1, prefix, mark 3, middle; plain is
    the text as it is, with null counts of characters.

    Plain are: null (taken as empty) and empty texts, those that hold a mark or in whose output a mark would occur twice, and
    those that units don't cover, whose n is 0. Rows are treated one by one, so repeated rows come out alike; a null id draws
    like an empty one. A text of any length is matched whole. An empty table gives no rows; other columns are not looked at.
    """
    pattern = regex.compile(f"(?:({unit}))*+")
    before, after, gap = marks

    def cut(text: str, doc_id: int | None) -> tuple[int, str, int | None, int | None, str]:
        found = pattern.fullmatch(text)
        ends = [0, *found.ends(1)] if found else [0]
        n = len(ends) - 1
        first, second, drawn, order = _draws(seed, doc_id)
        if n and drawn % 100 < fim_percent and not any(m in text for m in marks):
            a, b = (ends[i] for i in sorted((first % (n + 1), second % (n + 1))))
            prefix, middle, suffix = text[:a], text[a:b], text[b:]
            spm = order % 100 < spm_percent
            output = after + suffix + before + prefix + gap + middle if spm else before + prefix + after + suffix + gap + middle
            if all(output.count(m) == 1 for m in marks):
                return n, "spm" if spm else "psm", a, b - a, output
        return n, "plain", None, None, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                some = batch.slice(block.first, block.last - block.first)
                ids = some.column(0).to_pylist()
                rows = [cut(text or "", i) for i, text in zip(ids, some.column(1).to_pylist())]
                n, form, a, b, output = zip(*rows)
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(x, t) for x, t in ((n, pa.int64()), (form, pa.string()), (a, pa.int64()), (b, pa.int64()), (output, pa.string())))],
                                                 names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return text_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SHAPE)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from which `fill_in_middle` made the output."""
    before, after, gap = map(F.lit, marks)
    part = lambda text, mark, k: F.split_part(text, mark, F.lit(k))
    middle, rest = part(output, gap, 2), part(output, gap, 1)
    psm = F.concat(part(part(rest, after, 1), before, 2), middle, part(rest, after, 2))
    spm = F.concat(part(rest, before, 2), middle, part(part(rest, before, 1), after, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
