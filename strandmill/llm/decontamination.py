"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and characters beyond ASCII.  Of every
run of `window` consecutive hashes of `gram` words the smallest one (the last of equals) is a fingerprint, so
any `gram + window - 1` consecutive words that a document shares with an item leave a fingerprint that both
have.  A document's fingerprints are looked up among the items'; around a hit, whole spans of that many words
are compared by two independent 64-bit hashes.  An item of fewer words, but not none, is one span, looked up whole.

The items' spans are broadcast in slices of a fixed number of bytes of text (a longer item is a slice), so what is
broadcast is bounded; for a benchmark of more than one slice, the documents are numbered and written, each slice takes a
pass over them and what the passes find is united by number.
Null and empty texts have no words and hit nothing.  Repeated rows each get a row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm._bytes import ALPHANUMERIC, LOWER, chunks, gram_hashes, gram_starts, ragged_range, scan_words, text_array, text_bytes, word_hashes
from strandmill.llm._shared import written

GRAM, WINDOW = 5, 6
#: Bytes of benchmark text in a slice; a span takes 24 bytes and there is one a word at most.
SLICE_BYTES = 8 << 20
_FILTER_BITS = 20


def winnow(hashes: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the last smallest hash of some `window` positions from one of `first` on."""
    best, at = hashes[first], first.copy()
    for step in range(1, window):
        h = hashes[first + step]
        later = h <= best
        best, at = np.where(later, h, best), np.where(later, first + step, at)
    if len(at):
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at


class Scanned:
    """The words of a run of texts, hashed twice."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        lower = LOWER[buf]
        starts, ends, self.first = scan_words(lower, bounds, ALPHANUMERIC)
        self.words = [word_hashes(s, lower, starts, ends) for s in (71, 72)]

    def spans(self, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(gram_hashes(w, first, length) for w in self.words)

    def fingerprints(self, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of fingerprints and their hashes."""
        inner = gram_starts(self.first, gram)
        hashes = np.zeros(len(self.words[0]) + window, np.uint64)
        hashes[inner] = gram_hashes(self.words[0], inner, gram)
        at = np.unique(winnow(hashes, gram_starts(self.first, gram + window - 1), window))
        return at, hashes[at]


class Spans:
    """The spans of some benchmark items: their fingerprints, and per span length its sorted hashes and their items."""

    def __init__(self, texts: list[str | None], gram: int, window: int):
        self.gram, self.window, self.length = gram, window, gram + window - 1
        buf, bounds = text_bytes(text_array(pa.array(texts, pa.large_string())))
        seen = Scanned(buf, bounds)
        count = np.diff(seen.first)
        self.marks = np.unique(seen.fingerprints(gram, window)[1])
        self.marked = self._filter(self.marks)
        self.tables = {}
        for length in {self.length, *(int(n) for n in count if 0 < n < self.length)}:
            use = count >= length if length == self.length else count == length
            first = ragged_range(seen.first[:-1][use], count[use] - length + 1)
            item = np.repeat(np.flatnonzero(use), count[use] - length + 1)
            a, b = seen.spans(first, length)
            order = np.lexsort((item, b, a))
            self.tables[length] = (a[order], b[order], item[order], self._filter(a))

    @staticmethod
    def _filter(hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << _FILTER_BITS, bool)
        out[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        return out

    def candidates(self, seen: Scanned, length: int) -> np.ndarray:
        """First words of the spans that may be in the table of this length."""
        if length < self.length:
            return gram_starts(seen.first, length)
        at, hashes = seen.fingerprints(self.gram, self.window)
        maybe = self.marked[hashes >> np.uint64(64 - _FILTER_BITS)]
        at, hashes = at[maybe], hashes[maybe]
        at = at[np.isin(hashes, self.marks)]
        around = (at[:, None] - np.arange(self.window)).ravel()
        around = np.unique(around[around >= 0])
        text = np.searchsorted(seen.first, around, "right") - 1
        return around[around + length <= seen.first[text + 1]]

    def hits(self, seen: Scanned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, lengths and items of all spans found."""
        out = []
        for length, (a, b, item, maybe) in self.tables.items():
            first = self.candidates(seen, length)
            if not len(first) or not len(a):
                continue
            x, y = seen.spans(first, length)
            few = maybe[x >> np.uint64(64 - _FILTER_BITS)]
            first, x, y = first[few], x[few], y[few]
            low, high = np.searchsorted(a, x, "left"), np.searchsorted(a, x, "right")
            which = ragged_range(low, high - low)
            row = np.repeat(np.arange(len(first)), high - low)
            same = b[which] == y[row]
            out.append((first[row[same]], np.full(int(same.sum()), length), item[which[same]]))
        return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))


def _slices(items: DataFrame, item_col: str, text_col: str, size: int) -> Iterator[list[tuple[str, str]]]:
    """The items in slices of about `size` bytes of text, the driver holding one at a time; a longer item is a slice."""
    part, held = [], 0
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    for row in rows.toLocalIterator():
        n = len(row.text.encode())
        if part and held + n > size:
            yield part
            part, held = [], 0
        part.append((row.item, row.text))
        held += n
    yield part


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", gram: int = GRAM, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per document: id, n_words, hits (spans of words: first, length, in words from 0) and items (sorted ids)."""
    slices = _slices(items, item_col, item_text_col, slice_bytes)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    part, other = next(slices), next(slices, None)
    if other is None:
        return _pass(text, part, gram, window)
    numbered = written(text.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "numbered")
    found = _pass(numbered, part, gram, window)
    for part in itertools.chain([other], slices):
        found = found.unionByName(_pass(numbered, part, gram, window).where(F.size("hits") > 0))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return found.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), united("hits"), united("items")).drop("row")


def _pass(rows: DataFrame, part: list[tuple[str, str]], gram: int, window: int) -> DataFrame:
    """All columns of rows but the last, their text; n_words, hits and items."""
    shared = rows.sparkSession.sparkContext.broadcast((Spans([t for _, t in part], gram, window), [i for i, _ in part]))
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(_scanner(shared), f"{own}, n_words long, hits array<struct<first: long, length: int>>, items array<string>")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", gram: int = GRAM, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that share no span with any item; no shuffle."""
    at = docs.columns.index(text_col)
    for part in _slices(items, item_col, item_text_col, slice_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Spans([t for _, t in part], gram, window))
        docs = docs.mapInArrow(_cleaner(shared, at), docs.schema)
    return docs


def _cleaner(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = text_bytes(text_array(batch.column(at)))
            keep = np.ones(batch.num_rows, bool)
            for i, j in chunks(bounds):
                seen = Scanned(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                keep[i + np.searchsorted(seen.first, shared.value.hits(seen)[0], "right") - 1] = False
            yield batch.filter(pa.array(keep))

    return run


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, names = shared.value
        for batch in batches:
            *own_columns, texts = batch.columns
            buf, bounds = text_bytes(text_array(texts))
            counts, hits, items = [np.zeros(0, np.int64)], [], []
            for i, j in chunks(bounds):
                seen = Scanned(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                counts.append(np.diff(seen.first))
                first, length, item = spans.hits(seen)
                text = np.searchsorted(seen.first, first, "right") - 1
                own: list[dict] = [{} for _ in range(j - i)]
                for t, f, k, m in zip(text.tolist(), (first - seen.first[text]).tolist(), length.tolist(), item.tolist(), strict=True):
                    own[t].setdefault("hits", set()).add((f, k))
                    own[t].setdefault("items", set()).add(names[m])
                hits += [[{"first": f, "length": k} for f, k in sorted(x.get("hits", ()))] for x in own]
                items += [sorted(x for x in x.get("items", ()) if x is not None) for x in own]
            kinds = pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int32())])), pa.list_(pa.string())
            found = [pa.array(x, k) for x, k in zip((np.concatenate(counts), hits, items), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*own_columns, *found], [*batch.schema.names[:-1], "n_words", "hits", "items"])

    return run


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per document: id, n_words, n_hit (words inside any span found), n_items, items_sha256, contaminated."""
    found = scan(docs, items, id_col, text_col, item_col, slice_bytes=slice_bytes)
    # spans come sorted by first word: each adds what reaches beyond all before it
    spans = F.array_sort("hits")
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, span):
        end = span["first"] + span["length"]
        new = F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["end"], span["first"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    n_hit = F.when(F.size("hits") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(spans, start, step)["n"])
    return found.select(
        "id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
