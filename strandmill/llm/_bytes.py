"""Vectorised word scanning and hashes of words over Arrow text buffers.

All helpers work on the UTF-8 bytes of a whole batch of texts at once.  The
word classes used here only name ASCII bytes, so scanning bytes and scanning
characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
BLANK_SEPARATED = np.ones(256, dtype=bool)
BLANK_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False

#: Words are maximal runs of ASCII letters, digits and bytes beyond ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

CHUNK_BYTES = 1 << 20


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one array in which nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column, "")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text starts (one more entry than texts)."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about `limit` bytes; a longer text is a run of its own."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, j
        i = j


def scan_words(buf: np.ndarray, bounds: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the number of its first word."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = word[buf]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(buf)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, one to one."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


#: Multiplier of a run of words before the next is added: a fixed value, any odd number does.
_STEP = np.uint64(0x5851F42D4C957F2D)
#: Words of more bytes are hashed one by one.
_LONG = 256
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(seed: int, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, given by where their bytes start and end.

    Eight bytes are taken in at a time and mixed in one to one, all words advancing together.  Nothing here is a
    polynomial, so words do not collide by their form (as those of few letters do modulo a power of two), and
    hashes of two seeds are independent.
    """
    size = ends - starts
    eight = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))  # from each byte on
    out = mix(np.full(len(size), seed, np.uint64) * _STEP + size.astype(np.uint64))
    live = np.flatnonzero(size <= _LONG)
    at = 0
    while len(live):
        value = eight[starts[live] + at] & _LOW_BYTES[np.minimum(size[live] - at, 8)]
        out[live] = mix(out[live] ^ value)
        at += 8
        live = live[size[live] > at]
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]].tobytes(), seed)
    return out


def gram_hashes(words: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Hashes of `length` word hashes from each of the positions `first` on, from runs of 1, 2, 4, ... words."""
    few = len(first) * length < len(words)  # then only their own words are looked at, each run a row
    part = words[first[:, None] + np.arange(length)] if few else words
    out, done, size = None, 0, 1
    while True:
        if length & size:
            own = part[:, done] if few else part[first + done]
            out = own if out is None else mix(out * _STEP + own)
            done += size
        if 2 * size > length:
            return out
        part = mix(part[..., :-size] * _STEP + part[..., size:])
        size *= 2


def gram_starts(first_word: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the words at which a run of `length` words of one text starts."""
    counts = np.maximum(np.diff(first_word) - length + 1, 0)
    return ragged_range(first_word[:-1], counts)


def ragged_range(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] of them), first[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(first - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + shift


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column whose rows take `counts` values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
