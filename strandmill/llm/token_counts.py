"""Token counts of whole texts by a count-only Viterbi search.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at each character of a segment, the
longest first; dynamic programming carries the best score and its number of pieces to each end, and no back
pointers.  A later candidate replaces the best one only if its score is greater, so of equal paths the one whose
last piece is longest stays, as in the tokenizer.  A character that is no piece costs the worst score less a
penalty and counts as its UTF-8 bytes if the vocabulary has byte pieces, else as one.

Null and empty texts have 0 tokens and score 0.  Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm._bytes import chunks, text_array, text_bytes
from strandmill.llm._pieces import MARK, Pieces, Remembered, segments

_CHUNK = 2 << 20


class Counter:
    """Counts the pieces of segments."""

    def __init__(self, pieces: Pieces):
        self._unknown, self._bytes = pieces.unknown_score, pieces.bytes_fallback
        self._automaton = ahocorasick.Automaton()
        for i in pieces.plain:
            self._automaton.add_word(pieces.text[i], (len(pieces.text[i]), float(pieces.scores[i])))
        self._automaton.make_automaton()

    def count(self, segment: str) -> tuple[int, float]:
        """The number of pieces of the best path over a marked segment, and its score."""
        n, worst = len(segment), -np.inf
        best, count = [0.0] + [worst] * n, [0] * (n + 1)
        single = bytearray(n + 1)
        done = 0

        def finish(end: int) -> None:
            """The unknown character as the last candidate at an end without a piece of that one character."""
            if not single[end] and (score := best[end - 1] + self._unknown) > best[end]:
                best[end] = score
                count[end] = count[end - 1] + (len(segment[end - 1].encode("utf-8", "surrogatepass")) if self._bytes else 1)

        for last, (length, own) in self._automaton.iter(segment):
            end = last + 1
            while done < last:
                done += 1
                if not single[done]:
                    finish(done)
            if length == 1:
                single[end] = 1
            score = best[end - length] + own
            if score > best[end]:
                best[end] = score
                count[end] = count[end - length] + 1
        while done < n:
            done += 1
            finish(done)
        return count[n], best[n]

    def __call__(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.count(MARK + k.replace(" ", MARK)) for k in keys]
        return np.array([c for c, _ in found], np.int64), np.array([s for _, s in found], np.float64)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score): one row per row of docs; score is the sum of the best paths' scores."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Remembered(Counter(shared.value))
        for batch in batches:
            texts = text_array(batch.column(1))
            tokens, scores = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for i, j in chunks(text_bytes(texts)[1], _CHUNK):
                own = [segments(t) for t in texts.slice(i, j - i).to_pylist()]
                sizes = np.array([len(x) for x in own])
                number, (n, score) = count([k for x in own for k in x]) if sizes.any() else (np.zeros(0, int), (np.zeros(0, int), np.zeros(0)))
                text = np.repeat(np.arange(j - i), sizes)
                tokens[i:j] = np.bincount(text, n[number], j - i).astype(np.int64)
                scores[i:j] = np.bincount(text, score[number], j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), pa.array(scores)], ["id", "n_tokens", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, score double")
