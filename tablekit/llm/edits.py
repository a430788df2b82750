"""Edit-aware token counts: a segment tree of token counts per document, updated by re-encoding only what edits touch.

A leaf is a run of pre-tokens, cut where the tokenizer always cuts whatever lies further off (see tokens.pieces); a node's sum
is that of its two children. An edit re-encodes the leaves it touches, and a neighbour where it reaches the cut between them,
since only the characters on either side of a cut decide whether it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablekit.llm.arrays import Block, blocks
from tablekit.llm.tokens import PieceEncoder, encoder, pieces, tokenizer_text

#: A leaf ends at the first cut after so many bytes.
LEAF_BYTES = 256
_COUNTS = "doc_id long, n_tokens_before long, n_tokens long, n_edits long, n_chars long, n_reencoded long"
_TREE = pa.struct([("chars", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64()))])
_EDITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
#: What the cleaning edits mask.
_MAIL, _DIGITS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), re.compile(r"\+?[0-9](?:[ .-]?[0-9]){6,}")


def _field(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{name}` {kind}"])


def cleaning_edits(docs: DataFrame) -> DataFrame:
    """`docs` with a column `edits` (start, end, text; code points, ascending, apart): mail addresses and long numbers are
    masked, and lines equal to an earlier one of the text are taken out with their line break. Null text has none."""
    place = docs.columns.index("text")
    return docs.mapInArrow(lambda batches: _find(batches, place), _field(docs, "edits", "array<struct<start:int,end:int,text:string>>"))


def _sliced(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds a block of text, which bounds what a task holds at a time."""
    for batch in batches:
        for block in blocks(batch.column(place)):
            yield batch.slice(block.first, block.last - block.first)


def _find(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches, place):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_cleaning(t or "") for t in batch.column(place).to_pylist()], _EDITS)], names=[*batch.schema.names, "edits"])


def _cleaning(text: str) -> list[dict]:
    gone, seen, at = [], set(), 0
    for line in text.split("\n"):
        if line.strip() and line in seen:
            gone.append((max(at - 1, 0), at + len(line), ""))
        seen.add(line)
        at += len(line) + 1
    found = gone + [(*m.span(), "<MAIL>") for m in _MAIL.finditer(text)] + [(*m.span(), "<NUMBER>") for m in _DIGITS.finditer(text)]
    out: list[dict] = []
    for start, end, new in sorted(found):
        if not out or start >= out[-1]["end"]:
            out.append({"start": start, "end": end, "text": new})
    return out


def leaf_counts(block: Block, encode: PieceEncoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, tokens) of every leaf of a block's texts in a row, and the first leaf of each text."""
    start, end, first = pieces(block, encode.special)
    _, counts, _ = encode.encode_pieces(block, start, end)
    leaf = np.zeros(len(start), bool)
    leaf[first[:-1][first[1:] > first[:-1]]] = True
    # A leaf begins where a text does, or where a multiple of LEAF_BYTES (from the text's beginning) was passed.
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    step = (start - block.offsets[text]) // LEAF_BYTES
    leaf[1:] |= step[1:] != step[:-1]
    at = np.flatnonzero(leaf)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    chars = np.diff(np.append(points[start[at]], points[-1]))
    return chars, np.add.reduceat(counts, at), np.searchsorted(at, first)


def build_tree(tokens: np.ndarray) -> np.ndarray:
    """Sums in heap order: entry 1 is the root, entry m + i is leaf i of m = the next power of two."""
    m = 1 << max(0, int(len(tokens) - 1).bit_length())
    sums = np.zeros(2 * m, np.int64)
    sums[m:m + len(tokens)] = tokens
    while m > 1:
        sums[m // 2:m] = sums[m:2 * m:2] + sums[m + 1:2 * m:2]
        m //= 2
    return sums


def set_leaves(sums: np.ndarray, values: dict[int, int]) -> None:
    """Give leaves new counts and mend the sums on their paths to the root."""
    m = len(sums) // 2
    for leaf, value in values.items():
        node = m + leaf
        change = value - sums[node]
        while node and change:
            sums[node] += change
            node //= 2


def with_trees(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """`docs` with a column `tree`: code points of each leaf and the sums in heap order. Null or empty text has one empty
    leaf. Store it beside the text; edits then cost what they touch."""
    tokenizer, place = tokenizer_text(tokenizer_path), docs.columns.index("text")
    return docs.mapInArrow(lambda batches: _plant(batches, place, tokenizer), _field(docs, "tree", "struct<chars:array<int>,sums:array<bigint>>"))


def _plant(batches: Iterator[pa.RecordBatch], place: int, tokenizer: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer)
    for batch in _sliced(batches, place):
        trees = []
        for block in blocks(batch.column(place)):
            chars, tokens, first = leaf_counts(block, encode)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                trees.append({"chars": chars[a:b] if b > a else [0], "sums": build_tree(tokens[a:b] if b > a else np.zeros(1, np.int64))})
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees, _TREE)], names=[*batch.schema.names, "tree"])


def touched_regions(chars: np.ndarray, edits: list[dict]) -> list[tuple[int, int, list[dict]]]:
    """(first leaf, last leaf, edits) of each region to re-encode; regions share no leaf."""
    ends = np.cumsum(chars)
    begins = ends - chars
    regions: list[tuple[int, int, list[dict]]] = []
    for edit in edits:
        low = max(0, int(np.searchsorted(ends, edit["start"], "left")))  # a leaf that ends where the edit begins is touched
        high = max(low, min(len(chars) - 1, int(np.searchsorted(begins, edit["end"], "right")) - 1))  # so is one that begins where it ends
        low = min(low, len(chars) - 1)
        if regions and low <= regions[-1][1]:
            regions[-1] = (regions[-1][0], max(high, regions[-1][1]), [*regions[-1][2], edit])
        else:
            regions.append((low, high, [edit]))
    return regions


def edited_counts(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text, tree, edits): doc_id, n_tokens_before, n_tokens (of the edited text), n_edits,
    n_chars (of the text), n_reencoded (code points that went through the tokenizer again).

    Edits are ascending and apart; null means none. A text that gains or holds a special token's string after its edits is
    encoded anew as a whole, as such a string may reach over cuts. Rows are handled one by one; an empty table gives no rows.
    """
    tokenizer = tokenizer_text(tokenizer_path)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", "tree", "edits")
    return own.mapInArrow(lambda batches: _apply(batches, tokenizer), _COUNTS)


def cleaned_counts(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """`edited_counts` of the cleaning edits: edits found, trees planted and edits applied in one pass, by one worker."""
    tokenizer = tokenizer_text(tokenizer_path)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return own.mapInArrow(lambda batches: _apply(_plant(_find(batches, 1), 1, tokenizer), tokenizer), _COUNTS)


def _apply(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer)
    for batch in _sliced(batches, 1):
        n = batch.num_rows
        edits = batch.column("edits").to_pylist()
        trees, texts = batch.column("tree"), batch.column("text")
        before, after, size, again = (np.zeros(n, np.int64) for _ in range(4))
        jobs: list[tuple[int, int, int]] = []  # row, first leaf, last leaf
        pending: list[str] = []
        sums_of: dict[int, np.ndarray] = {}
        for i in range(n):
            text, tree = texts[i].as_py() or "", trees[i]
            sums = np.array(tree["sums"].values, np.int64)
            before[i] = after[i] = sums[1]
            size[i] = len(text)
            if not edits[i]:
                continue
            chars = np.array(tree["chars"].values, np.int64)
            regions = touched_regions(chars, edits[i])
            if any(m in _edited(text, 0, len(text), edits[i]) for m in encode.marks):
                regions = [(0, len(chars) - 1, edits[i])]
            ends = np.cumsum(chars)
            sums_of[i] = sums
            for low, high, own in regions:
                begin, end = int(ends[low] - chars[low]), int(ends[high])
                jobs.append((i, low, high))
                pending.append(_edited(text, begin, end, own))
                again[i] += len(pending[-1])
        counts = np.concatenate([encode.encode(block)[1] for block in blocks(pa.array(pending, pa.string()))]) if pending else []
        for (i, low, high), count in zip(jobs, counts):
            set_leaves(sums_of[i], {low: int(count), **dict.fromkeys(range(low + 1, high + 1), 0)})
        for i, sums in sums_of.items():
            after[i] = sums[1]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens_before": pa.array(before), "n_tokens": pa.array(after), "n_edits": pa.array([len(e or []) for e in edits], pa.int64()),
                                          "n_chars": pa.array(size), "n_reencoded": pa.array(again)})


def _edited(text: str, begin: int, end: int, edits: list[dict]) -> str:
    out, at = [], begin
    for edit in edits:
        out += [text[at:edit["start"]], edit["text"] or ""]
        at = edit["end"]
    return "".join([*out, text[at:end]])
