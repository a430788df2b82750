"""Token ids of whole texts by the tokenizers library, with a bounded memory of pieces that were seen before.

A text is cut only where the byte-level pre-tokenizer always cuts and where what follows does not depend on what came
before: a visible ASCII character (or, in texts whose non-ASCII characters are all Latin-1 letters, any letter) before ASCII
white space; a letter or digit before ASCII punctuation; ASCII punctuation other than an apostrophe before a letter or
digit. The ids of a text are then those of its pieces in a row, and a piece is encoded once.
"""

from __future__ import annotations

import itertools
import os

import numpy as np

from tablekit.llm.arrays import ALPHANUMERIC, NOT_SPACE, Block, span_hashes

_PROBES = 8
_JOINED = 500
_codes = np.arange(256)
_SPACE, _VISIBLE = ~NOT_SPACE, (_codes > 32) & (_codes < 127)
_PUNCTUATION = _VISIBLE & ~ALPHANUMERIC
_BREAKS_BEFORE_WORD = _PUNCTUATION & (_codes != ord("'"))
_open: dict[int, "PieceEncoder"] = {}


def pieces(block: Block, special: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each piece, and for each text the index of its first piece. Texts with a special token stay whole."""
    data, at = block.data, block.offsets
    n = len(data)
    cut = np.zeros(n, bool)
    if n:
        high = data >= 128
        plain = np.ones(len(at) - 1, bool)
        if high.any():
            letter = np.zeros(n, bool)
            letter[:-1] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            letter[1:] |= letter[:-1]
            odd = np.flatnonzero(high & ~letter)
            plain[np.searchsorted(at, odd, "right") - 1] = False
        fine = np.repeat(plain, np.diff(at))
        before, here = data[:-1], data[1:]
        word = ALPHANUMERIC[data]
        cut[1:] = (_SPACE[here] & (_VISIBLE[before] | (high[:-1] & fine[1:]))) | (fine[1:] & (
            (word[:-1] & _PUNCTUATION[here]) | (_BREAKS_BEFORE_WORD[before] & word[1:])))
        if special:
            raw = data.tobytes()
            for mark in special:
                found = raw.find(mark)
                while found >= 0:
                    k = int(np.searchsorted(at, found, "right")) - 1
                    cut[at[k]:at[k + 1]] = False
                    found = raw.find(mark, max(int(at[k + 1]), found + 1))
        cut[at[:-1][at[1:] > at[:-1]]] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], n), np.searchsorted(start, at)


class PieceEncoder:
    """Ids of texts by a tokenizers file given as JSON text. `room`: pieces kept at most; beyond it the memory is emptied."""

    def __init__(self, tokenizer_json: str, room: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self.marks = [x.content for x in self._tokenizer.get_added_tokens_decoder().values()]
        self.special = tuple(x.encode() for x in self.marks)
        line = self._tokenizer.encode("\n", add_special_tokens=False).ids
        self._line_break = line[0] if len(line) == 1 else -1
        self._room, self._mask = room, np.uint64(2 * room - 1)
        self._forget()

    def _forget(self) -> None:
        self._keys, self._rows = np.zeros(int(self._mask) + 1, np.uint64), np.zeros(int(self._mask) + 1, np.int32)
        self._start, self._length, self._n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self._ids, self._used = np.zeros(1 << 18, np.uint32), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 where it is not known."""
        slot = (hashes & self._mask).astype(np.int64)
        row = np.where(self._keys[slot] == hashes, self._rows[slot], -1)
        left = np.flatnonzero(row < 0)
        for step in range(1, _PROBES):
            if not len(left):
                break
            slot = ((hashes[left] + np.uint64(step)) & self._mask).astype(np.int64)
            hit = self._keys[slot] == hashes[left]
            row[left[hit]] = self._rows[slot[hit]]
            left = left[~hit & (self._keys[slot] != 0)]
        return row

    def _learn(self, hashes: np.ndarray, encoded: list[list[int]]) -> np.ndarray:
        lengths = np.fromiter(map(len, encoded), np.int32, len(encoded))
        ids = np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(lengths.sum()))
        rows = np.arange(self._n, self._n + len(encoded))
        while self._n + len(encoded) > len(self._start):
            self._start, self._length = np.concatenate([self._start, np.zeros_like(self._start)]), np.concatenate([self._length, np.zeros_like(self._length)])
        while self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._start[rows], self._length[rows] = self._used + np.cumsum(lengths) - lengths, lengths
        self._ids[self._used:self._used + len(ids)] = ids
        self._n, self._used = self._n + len(encoded), self._used + len(ids)
        left, left_rows = hashes, rows
        for step in range(_PROBES):
            slot = ((left + np.uint64(step)) & self._mask).astype(np.int64)
            free = self._keys[slot] == 0
            self._keys[slot[free]] = left[free]
            own = free & (self._keys[slot] == left)
            self._rows[slot[own]] = left_rows[own]
            left, left_rows = left[~own], left_rows[~own]
        return rows

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        """Ids of each piece. Pieces with no white space but one leading blank are encoded many at a time, with line breaks
        between them, which the pre-tokenizer keeps apart; where the breaks don't come back one by one, each goes alone."""
        out: list[list[int] | None] = [None] * len(texts)
        joined = [i for i, x in enumerate(texts) if not any(c.isspace() for c in x[1:]) and (x[:1] == " " or not x[:1].isspace()) and not any(m in x for m in self.marks)]
        for at in range(0, len(joined), _JOINED):
            some = joined[at:at + _JOINED]
            ids = self._tokenizer.encode_batch_fast(["\n".join(texts[i] for i in some)], add_special_tokens=False)[0].ids
            breaks = [-1, *(k for k, x in enumerate(ids) if x == self._line_break), len(ids)]
            if len(breaks) == len(some) + 1:
                for i, a, b in zip(some, breaks, breaks[1:]):
                    out[i] = ids[a + 1:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = x.ids
        return out

    def encode_pieces(self, block: Block, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the pieces in a row, how many each has, and their running total."""
        if self._n > self._room:
            self._forget()
        hashes = span_hashes(block.data, start, end)
        hashes[hashes == 0] = 1
        row = self._find(hashes)
        missing = np.flatnonzero(row < 0)
        if len(missing):
            new, at, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            raw, at = block.data.tobytes(), missing[at]
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[at].tolist(), end[at].tolist())]
            row[missing] = self._learn(new, self._encoded(texts))[which]
        lengths = self._length[row].astype(np.int64)
        ends = np.cumsum(lengths)
        ids = self._ids[np.repeat(self._start[row] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, lengths, np.concatenate([np.zeros(1, np.int64), ends])

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of the block in a row, and how many each text has."""
        start, end, first = pieces(block, self.special)
        ids, _, ends = self.encode_pieces(block, start, end)
        return ids, ends[first[1:]] - ends[first[:-1]]


def encoder(tokenizer_json: str) -> PieceEncoder:
    """This worker's encoder of a tokenizer: made once, used by all its tasks."""
    key = hash(tokenizer_json)
    if key not in _open:
        _open[key] = PieceEncoder(tokenizer_json)
    return _open[key]


def default_tokenizer() -> str:
    """The path of the byte-level BPE file with 50 257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_text(path: str | None = None) -> str:
    """The tokenizer file's text, read on the driver and sent with the tasks, so that executors need no copy."""
    with open(path or default_tokenizer(), encoding="utf-8") as file:
        return file.read()
