"""Words of many texts at once: numpy work on the bytes of an Arrow string column, inside tasks.

Word classes here are sets of ASCII bytes plus every byte of a non-ASCII character, so cutting bytes equals cutting code
points. A word is known by a 64-bit hash (polynomial over random byte values, then mixed); two different words share one
with a chance of about 5e-20.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time (one longer text is worked on whole). Bounds the memory of a task.
BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUES_FOLDED = _VALUES[_LOWER]
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

_codes = np.arange(256)
#: `[^\x20\x09-\x0D]`: everything but ASCII white space.
NOT_SPACE = ~((_codes == 32) | ((_codes >= 9) & (_codes <= 13)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z: ASCII letters, digits and all that is not ASCII.
ALPHANUMERIC = (_codes >= 128) | ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122))


class Block(NamedTuple):
    """Texts `first` to `last` (exclusive) of a column: their bytes, and where each begins (one more entry than texts)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Byte spans of words, their hashes, and for each text the index of its first word (one more entry than texts)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The index of each word's text within its block."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a column into runs of texts of at most `limit` bytes; a longer text is a block of its own."""
    data, at = string_bytes(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield Block(first, last, data[at[first]:at[last]], at[first:last + 1] - at[first])
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, BLOCK_BYTES), _BASE if kind == "up" else _INVERSE)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """A hash of each byte span, the same wherever the span lies; `fold` takes A-Z as a-z."""
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_VALUES_FOLDED if fold else _VALUES)[data] * _power("up", len(data)), out=total[1:])
    return mixed((total[end] - total[start]) * _power("down", len(data))[start])


def spans(block: Block, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of bytes of `kind` within each text, and for each text the index of its first run."""
    data, at = block.data, block.offsets
    inside = kind[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    filled = at[:-1][at[1:] > at[:-1]]
    begin[filled] = inside[filled]
    last = at[1:][at[1:] > at[:-1]] - 1
    stop[last] = inside[last]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, at)


def words(block: Block, kind: np.ndarray, fold: bool = False) -> Words:
    """Maximal runs of bytes of `kind` within each text."""
    start, end, first = spans(block, kind)
    return Words(start, end, span_hashes(block.data, start, end, fold), first)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of values[first[i]:first[i + 1]] for each i (also where that is empty)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.result_type(values.dtype, np.int64) if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
