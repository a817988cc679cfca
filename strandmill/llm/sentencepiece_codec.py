"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

Segments of equal length advance together, one character a step.  Hashes of all their substrings probe the sorted
hashes of the pieces of that length; at each end, the best of up to as many candidates as a piece has characters is
taken by a vectorised maximum over candidates from the longest to the shortest, so of equal paths the one with the
longest last piece stays, as in the tokenizer.  Back pointers are lengths; following them gives ids.  A character
that is no piece becomes its UTF-8 bytes' pieces, or the unknown id where the vocabulary has none.

Encoding gives no ids for null and empty texts.  Decoding gives the text back, but for U+2581, which becomes a
space; without byte pieces, unknown characters are lost.  Ids outside the vocabulary raise an error; null id lists
decode to an empty text.  Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm._bytes import chunks, list_array, mix, ragged_range, text_array, text_bytes
from strandmill.llm._pieces import MARK, Pieces, Remembered, segments
from strandmill.llm._shared import released

_CHUNK = 2 << 20
#: Characters of segments that advance together.
_CELLS = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _substrings(codes: np.ndarray, length: int, prefix: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Hashes of all runs of `length` characters of each row."""
    last = codes.shape[1] - length + 1
    return mix((prefix[:, length : length + last] - prefix[:, :last]) * down[:last])


class Encoder:
    """Encodes segments."""

    def __init__(self, pieces: Pieces):
        self._pieces = pieces
        self._tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[int]] = {}
        for i in pieces.plain:
            by_length.setdefault(len(pieces.text[i]), []).append(i)
        for length, ids in by_length.items():
            codes = self._codes([pieces.text[i] for i in ids]).reshape(-1, length)
            keys = _substrings(codes, length, self._prefix(codes), _powers(_INVERSE, length + 1))[:, 0]
            order = np.argsort(keys)
            if (keys[order][1:] == keys[order][:-1]).any():
                raise ValueError("two pieces have one hash")
            self._tables[length] = keys[order], np.array(ids, np.int32)[order]
        self.longest = max(by_length)

    @staticmethod
    def _codes(texts: list[str]) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")

    @staticmethod
    def _prefix(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, codes.shape[1]), axis=1, out=out[:, 1:])
        return out

    def _equal(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of one length, one row after the other, and how many each has."""
        n, size = codes.shape
        prefix, down = self._prefix(codes), _powers(_INVERSE, size + 1)
        reach = min(self.longest, size)
        ids = np.full((reach + 1, n, size), -1, np.int32)
        scores = np.full((reach + 1, n, size), -np.inf)
        for length in range(1, reach + 1):
            keys, own = self._tables.get(length, (np.zeros(0, np.uint64), np.zeros(0, np.int32)))
            if not len(keys):
                continue
            probe = _substrings(codes, length, prefix, down)
            at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            found = keys[at] == probe
            ids[length, :, : size - length + 1][found] = own[at[found]]
            scores[length, :, : size - length + 1][found] = self._pieces.scores[own[at[found]]]
        none = ids[1] < 0
        ids[1][none], scores[1][none] = self._pieces.unknown, self._pieces.unknown_score
        best, back = np.zeros((n, size + 1)), np.zeros((n, size + 1), np.int64)
        row = np.arange(n)
        for end in range(1, size + 1):
            lengths = np.arange(min(reach, end), 0, -1)
            candidates = best[:, end - lengths] + scores[lengths, :, end - lengths].T
            most = candidates.argmax(axis=1)
            best[:, end], back[:, end] = candidates[row, most], lengths[most]
        out = np.full((n, size), -1, np.int32)
        at = np.full(n, size)
        live = row
        while len(live):
            length = back[live, at[live]]
            out[live, at[live] - 1] = ids[length, live, at[live] - length]
            at[live] -= length
            live = live[at[live] > 0]
        counts = (out >= 0).sum(axis=1)
        flat = out[out >= 0]
        if self._pieces.bytes_fallback and (flat == self._pieces.unknown).any():
            flat, counts = self._fall_back(flat, counts, codes[(out == self._pieces.unknown)])
        return flat, counts

    def _fall_back(self, flat: np.ndarray, counts: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes in place of unknown characters, which are given in their order."""
        where = np.flatnonzero(flat == self._pieces.unknown)
        texts = [chr(c).encode("utf-8", "surrogatepass") for c in unknown.tolist()]
        size = np.ones(len(flat), np.int64)
        size[where] = [len(t) for t in texts]
        row = np.repeat(np.arange(len(counts)), counts)
        out = np.repeat(flat, size)
        first = (np.cumsum(size) - size)[where]
        out[ragged_range(first, size[where])] = self._pieces.byte_ids[np.frombuffer(b"".join(texts), np.uint8)]
        return out, np.bincount(row, size, len(counts)).astype(np.int64)

    def __call__(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, one after the other, and how many each has."""
        marked = [MARK + k.replace(" ", MARK) for k in keys]
        size = np.array([len(m) for m in marked], np.int64)
        codes, first = self._codes(marked), np.cumsum(size) - size
        order = np.argsort(size, kind="stable")
        counts = np.zeros(len(keys), np.int64)
        parts = []
        cut = np.concatenate([[0], np.flatnonzero(np.diff(size[order])) + 1, [len(order)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            n = max(1, _CELLS // int(size[order[a]])) if b > a else 1
            for s in range(a, b, n):
                rows = order[s : min(b, s + n)]
                flat, own = self._equal(codes[first[rows][:, None] + np.arange(size[rows[0]])])
                parts.append(flat)
                counts[rows] = own
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        begin = np.empty(len(keys), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return flat[ragged_range(begin, counts)], counts


class _Ragged:
    """Adapts an encoder to Remembered: keeps ids and counts of what was seen, as one row of ids."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def batch(self, remember: Remembered, own: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        sizes = np.array([len(x) for x in own])
        if not sizes.any():
            return np.zeros(0, np.int32), np.zeros(len(own), np.int64)
        number, (flat, counts) = remember([k for x in own for k in x])
        begin = np.cumsum(counts) - counts
        per = counts[number]
        ids = flat[ragged_range(begin[number], per)]
        text = np.repeat(np.arange(len(own)), sizes)
        return ids, np.bincount(text, per, len(own)).astype(np.int64)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens): one row per row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ragged = _Ragged(Encoder(shared.value))
        remember = Remembered(ragged.encoder)
        for batch in batches:
            texts = text_array(batch.column(1))
            for i, j in chunks(text_bytes(texts)[1], _CHUNK):
                ids, counts = ragged.batch(remember, [segments(t) for t in texts.slice(i, j - i).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), list_array(pa.array(ids, pa.int32()), counts), pa.array(counts)], ["id", "ids", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: released(run(batches)), f"id {kind}, ids array<int>, n_tokens long")


def decode(tokens: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of tokens, and text."""
    shared = tokens.sparkSession.sparkContext.broadcast(Pieces(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = shared.value.surface
        size = np.array([len(s) for s in surface], np.int64)
        first, blob = np.cumsum(size) - size, np.frombuffer(b"".join(surface), np.uint8)
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids_col))
            texts = []
            for at in range(0, len(column), 256):
                part = column.slice(at, 256)
                n = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                data = blob[ragged_range(first[ids], size[ids])].tobytes()
                ends = np.concatenate([[0], np.cumsum(size[ids])])[np.cumsum(n)].tolist() if len(n) else []
                a = 0
                for b in ends:
                    own = data[a:b]
                    texts.append((own[1:] if own[:1] == b" " else own).decode("utf-8", "replace"))
                    a = b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(lambda batches: released(run(batches)), f"{kind}, text string")
