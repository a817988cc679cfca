"""A unigram piece vocabulary, and the segments of a text that can be encoded one by one.

The pieces and scores come from a SentencePiece model file, whose path is a parameter.  The scores are read as
unigram scores whatever kind of model the file was made for.  Text is prepared as such files with the identity
normaliser ask for: one space before a text that is not empty, spaces written as U+2581.  No piece has U+2581
after another character, so a text falls into segments (spaces, then other characters) that no piece crosses and
that are encoded alone, each different one once.  Scores are summed in double precision within a segment.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import sentencepiece

MARK = "▁"
#: How much worse an unknown character is than the worst piece: a fixed value of the format.
UNKNOWN_PENALTY = 10.0
#: Scores below this stand for one below all others.
HUGE = -1e8
#: Segments of which one worker process remembers the encoding.
REMEMBERED = 120_000
_SPACED = re.compile(" +[^ ]*")


class Pieces:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in ids]
        byte = {f"<0x{b:02X}>": b for b in range(256)}
        self.byte_ids = np.full(256, model.unk_id(), np.int32)
        surface = [t.replace(MARK, " ").encode() for t in self.text]
        plain = []
        for i in ids:
            if model.is_byte(i):
                self.byte_ids[byte[self.text[i]]] = i
                surface[i] = bytes([byte[self.text[i]]])
            elif model.is_control(i):
                surface[i] = b""
            elif model.is_unknown(i):
                surface[i] = " ⁇ ".encode()
            elif not model.is_unused(i):
                plain.append(i)
        self.plain = plain
        self.scores = np.array([model.get_score(i) for i in ids], np.float64)
        # files made for other kinds of model give some pieces a huge penalty, beside which others' scores vanish
        huge = [i for i in plain if self.scores[i] < HUGE]
        if len(huge) < len(plain):
            self.scores[huge] = self.scores[[i for i in plain if self.scores[i] >= HUGE]].min() - 1
        self.unknown = model.unk_id()
        self.unknown_score = float(self.scores[plain].min()) - UNKNOWN_PENALTY
        self.bytes_fallback = bool((self.byte_ids != self.unknown).all())
        self.surface = surface
        if any(MARK in self.text[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece has a space mark after another character")


def segments(text: str) -> list[str]:
    """The segments of a text, each without its first space mark and with spaces for the other marks."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in _SPACED.findall(" " + text)]


class Remembered:
    """Numbers segments, has the new ones encoded together and keeps what was found for them."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, ...]], limit: int = REMEMBERED):
        self._encode, self._limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self._number: dict[str, int] = {}
        self._found: list[tuple[np.ndarray, ...]] = []
        self._joined: tuple[np.ndarray, ...] | None = None

    def __call__(self, keys: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """The number of each key, and what `encode` gave, in order of those numbers."""
        if len(self._number) > self._limit:
            self._clear()
        number = self._number
        found = np.fromiter(map(number.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            unknown = [keys[i] for i in missing.tolist()]
            new = list(dict.fromkeys(unknown))
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            found[missing] = np.fromiter(map(number.__getitem__, unknown), np.int64, len(unknown))
            self._found.append(self._encode(new))
            self._joined = None
        if self._joined is None:
            if len(self._found) > 1:
                self._found = [tuple(np.concatenate(x) for x in zip(*self._found, strict=True))]
            self._joined = self._found[0] if self._found else ()
        return found, self._joined
