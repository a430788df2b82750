"""Wavelet matrix of a token sequence: bit-planes with rank and select, and its file format.

File: magic, counts, the shard's own alphabet (so that planes are only as many as its distinct tokens need), document ids and
ends, then the planes from the highest bit down; everything after the magic is zstandard-compressed part by part.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

#: Fixed value: the first bytes of every file.
MAGIC = b"WVMX0001"
_HEAD = struct.Struct("<8sQQII")
_PART = struct.Struct("<QQ")
_WORD = 64


def _bits_needed(n: int) -> int:
    return max(1, int(n - 1).bit_length())


def _code_type(width: int):
    return np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, doc_null: np.ndarray, doc_ends: np.ndarray) -> bytes:
    """The file of one shard. doc_ends: tokens of the shard up to and with each document; doc_null: documents without an id."""
    ids = np.ascontiguousarray(ids, np.uint32)
    seen = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    seen[ids] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    width = _bits_needed(len(alphabet))
    place = np.zeros(len(seen), _code_type(width))
    place[alphabet] = np.arange(len(alphabet))
    codes = place[ids]
    parts = [alphabet.tobytes(), doc_ids.astype("<i8").tobytes(), np.packbits(doc_null.astype(bool)).tobytes(), doc_ends.astype("<u8").tobytes()]
    zeros = []
    for level in range(width - 1, -1, -1):
        bit = (codes >> codes.dtype.type(level)) & codes.dtype.type(1) != 0
        parts.append(np.packbits(bit, bitorder="little").tobytes())
        low = codes[~bit]
        zeros.append(len(low))
        codes = np.concatenate([low, codes[bit]])
    parts.insert(4, np.array(zeros, "<u8").tobytes())
    squeeze = zstandard.ZstdCompressor(level=1)
    out = [_HEAD.pack(MAGIC, len(ids), len(doc_ids), len(alphabet), width)]
    for part in parts:
        small = squeeze.compress(part)
        out += [_PART.pack(len(part), len(small)), small]
    return b"".join(out)


class WaveletMatrix:
    """A shard file, opened. Positions count from 0; ranges exclude their end."""

    def __init__(self, raw: bytes):
        magic, self.n, n_docs, n_alphabet, self.width = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at, parts, expand = _HEAD.size, [], zstandard.ZstdDecompressor()
        for _ in range(5 + self.width):
            size, small = _PART.unpack_from(raw, at)
            at += _PART.size
            parts.append(expand.decompress(raw[at:at + small], max_output_size=size) if size else b"")
            at += small
        self.alphabet = np.frombuffer(parts[0], "<u4")
        self.doc_ids = np.frombuffer(parts[1], "<i8")
        self.doc_null = np.unpackbits(np.frombuffer(parts[2], np.uint8), count=n_docs).astype(bool)
        self.doc_ends = np.frombuffer(parts[3], "<u8").astype(np.int64)
        self._zeros = np.frombuffer(parts[4], "<u8").astype(np.int64)
        self._packed = [np.frombuffer(x, np.uint8) for x in parts[5:]]
        self._ranks: list[np.ndarray | None] = [None] * self.width
        assert len(self.alphabet) == n_alphabet

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self._packed[level], count=self.n, bitorder="little").view(bool)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each position of a plane: a directory of one count per 64 bits, and one masked word."""
        if self._ranks[level] is None:
            padded = np.zeros(-(-self.n // _WORD) * 8 + 8, np.uint8)
            padded[:len(self._packed[level])] = self._packed[level]
            lanes = padded.view("<u8")
            before = np.zeros(len(lanes) + 1, np.int64)
            np.cumsum(np.bitwise_count(lanes), out=before[1:])
            self._ranks[level] = (lanes, before)
        lanes, before = self._ranks[level]
        at = np.asarray(at, np.int64)
        mask = (np.uint64(1) << (at % _WORD).astype(np.uint64)) - np.uint64(1)
        return before[at // _WORD] + np.bitwise_count(lanes[at // _WORD] & mask)

    def _bit_at(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self._packed[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0

    def _code(self, token: int) -> int:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else -1

    def access(self, positions) -> np.ndarray:
        """The tokens at the positions."""
        at = np.atleast_1d(np.asarray(positions, np.int64))
        code = np.zeros(len(at), np.int64)
        for level in range(self.width):
            bit, ones = self._bit_at(level, at), self._ones(level, at)
            code = code * 2 + bit
            at = np.where(bit, self._zeros[level] + ones, at - ones)
        return self.alphabet[code]

    def rank(self, token: int, position: int) -> int:
        """How often the token occurs before the position."""
        return self.count(token, 0, position)

    def count(self, token: int, begin: int, end: int) -> int:
        """How often the token occurs in the range."""
        code = self._code(token)
        if code < 0 or end <= begin:
            return 0
        span = np.array([begin, end], np.int64)
        for level in range(self.width):
            ones = self._ones(level, span)
            span = self._zeros[level] + ones if code >> (self.width - 1 - level) & 1 else span - ones
        return int(span[1] - span[0])

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of the token, ascending: its run below the last plane, carried back up by select."""
        code = self._code(token)
        if code < 0:
            return np.zeros(0, np.int64)
        low, high = 0, self.n
        for level in range(self.width):
            ones = self._ones(level, np.array([low, high]))
            low, high = (self._zeros[level] + ones if code >> (self.width - 1 - level) & 1 else np.array([low, high]) - ones).tolist()
        at = np.arange(low, high)
        for level in range(self.width - 1, -1, -1):
            bit = self._bits(level)
            at = np.flatnonzero(bit)[at - self._zeros[level]] if code >> (self.width - 1 - level) & 1 else np.flatnonzero(~bit)[at]
        return at

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence (from 0), -1 if there are fewer."""
        where = self.occurrences(token)
        return int(where[k]) if 0 <= k < len(where) else -1

    def tokens(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        kind = _code_type(self.width)
        low = np.zeros(self.n, kind)
        for level in range(self.width - 1, -1, -1):
            bit, up = self._bits(level), np.empty(self.n, kind)
            up[~bit] = low[:self._zeros[level]]
            up[bit] = low[self._zeros[level]:] | kind(1 << (self.width - 1 - level))
            low = up
        return self.alphabet[low] if self.n else np.zeros(0, np.uint32)
