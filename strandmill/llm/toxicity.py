"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the embedding of its hash and the mean of the embeddings of its runs of 4 and 5 bytes, so inflected
forms of known words are known.  Two gated recurrent layers read a window of words in both directions, attention pools
their states and a logistic unit scores the pool.  All overlapping windows of a text are scored; the text's score is
that of its worst window, calibrated on a part of the training rows that the network has not seen.  Training takes
each document's worst window by the present network, starting from log-odds of words and runs.

The network is fitted on the driver on at most `SAMPLE` labelled documents of each class, those with the smallest hash
of their id, as far as they fit `SAMPLE_BYTES` of text together; everything else runs in tasks over all rows and whole texts.

Null and empty texts, and texts without a word, get the score of an empty pool.  Without rows of both classes every
score is the share of label 1 (0 without labels).  Repeated rows each get a row; null labels are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm._bytes import ALPHANUMERIC, LOWER, chunks, ragged_range, scan_words, text_array, text_bytes, word_hashes

SAMPLE, SAMPLE_BYTES, LONG_SHARE = 2000, 32 << 20, 16
LENGTH, STRIDE = 32, 24
THRESHOLD = 0.7
_BITS, _DIM, _HIDDEN, _ATTENTION = 15, 12, 8, 8
_GRAMS = (4, 5)
#: Words and texts whose runs are worked on at once, to bound memory.
_WORDS_AT_ONCE, _TEXTS_AT_ONCE = 1 << 15, 64
_EPOCHS, _BATCH, _RATE = 8, 128, 4e-3
_WORDS = ALPHANUMERIC.copy()
_WORDS[0x30:0x3A] = False  # digits are no part of a word here


class _Texts:
    """The different words of some texts, their features and the windows over all words."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        lower = LOWER[buf]
        # accented Latin capitals: C3 80 to C3 9E
        capital = np.zeros(len(lower), bool)
        capital[1:] = (lower[:-1] == 0xC3) & (lower[1:] >= 0x80) & (lower[1:] <= 0x9E)
        lower[capital] += 0x20
        starts, ends, self.first = scan_words(lower, bounds, _WORDS)
        hashes = np.empty(len(starts), np.uint64)
        for i, j in chunks(bounds):
            a, b, at = self.first[i], self.first[j], bounds[i]
            hashes[a:b] = word_hashes(81, lower[at : bounds[j]], starts[a:b] - at, ends[a:b] - at)
        different, at, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.bucket = (different >> np.uint64(64 - _BITS)).astype(np.int64)
        self._grams(lower, starts[at], ends[at])
        n = np.diff(self.first)
        windows = np.maximum(1, -(-(n - LENGTH) // STRIDE) + 1)
        self.text = np.repeat(np.arange(len(n)), windows)
        step = ragged_range(np.zeros(len(n), np.int64), windows)
        self.start = self.first[self.text] + step * STRIDE
        self.size = np.minimum(LENGTH, self.first[self.text + 1] - self.start)

    def _grams(self, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size = ends - starts
        first = np.cumsum(size + 2) - (size + 2)
        marked = np.full(int((size + 2).sum()), 0x20, np.uint64)
        marked[ragged_range(first + 1, size)] = lower[ragged_range(starts, size)]
        grams, owner = [], []
        for n in _GRAMS:
            count = np.maximum(size + 3 - n, 0)
            at = ragged_range(first, count)
            code = np.full(len(at), n, np.uint64)
            for k in range(n):
                code = (code << np.uint64(8)) | marked[at + k]
            grams.append(((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64))
            owner.append(np.repeat(np.arange(len(size)), count))
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.gram = np.concatenate(grams)[order]
        self.gram_count = np.bincount(owner, minlength=len(size))

    def mean_of_grams(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.gram_count), table.shape[1]), np.float32)
        end = np.cumsum(self.gram_count)
        for at in range(0, len(out), _WORDS_AT_ONCE):
            n = self.gram_count[at : at + _WORDS_AT_ONCE]
            grams = self.gram[end[at] - n[0] : end[at + len(n) - 1]]
            some = np.flatnonzero(n)
            if len(some):
                n = n[some]
                out[at + some] = np.add.reduceat(table[grams], np.cumsum(n) - n) / n[:, None]
        return out

    def places(self, windows: np.ndarray) -> np.ndarray:
        """Numbers of the different words at each step of windows (steps, windows); -1 past the end."""
        at = self.start[windows] + np.arange(LENGTH)[:, None]
        inside = np.arange(LENGTH)[:, None] < self.size[windows]
        return np.where(inside, self.word[np.where(inside, at, 0)], -1) if len(self.word) else np.full(at.shape, -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """The parameters, their gradients and scores."""

    def __init__(self, seed: int = 8):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        h = _HIDDEN
        self.p = {
            "word": normal(1 << _BITS, _DIM, scale=0.05),
            "gram": normal(1 << _BITS, _DIM, scale=0.05),
            "in": normal(2 * _DIM, 6 * h, scale=0.3),
            "in0": np.zeros(6 * h, np.float32),
            "rec0": normal(h, 3 * h, scale=0.3),
            "rec1": normal(h, 3 * h, scale=0.3),
            "att": normal(2 * h, _ATTENTION, scale=0.3),
            "att0": np.zeros(_ATTENTION, np.float32),
            "att1": normal(_ATTENTION, scale=0.5),
            "out": normal(2 * h, scale=0.5),
            "out0": np.zeros(1, np.float32),
        }
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, texts: _Texts) -> tuple[np.ndarray, np.ndarray]:
        """Each different word's vector, and what it adds to the gates (one more row, for no word)."""
        x = np.concatenate([self.p["word"][texts.bucket], texts.mean_of_grams(self.p["gram"])], axis=1)
        gates = np.zeros((len(x) + 1, 6 * _HIDDEN), np.float32)
        gates[:-1] = x @ self.p["in"] + self.p["in0"]
        return x, gates

    def forward(self, gates: np.ndarray, places: np.ndarray, keep: bool = False):
        """Logits of windows, given the rows of gates at each step."""
        steps, n = places.shape
        h = _HIDDEN
        mask = (places >= 0).astype(np.float32)[:, :, None]
        states = np.zeros((steps, n, 2 * h), np.float32)
        trace = []
        for way in (0, 1):
            rec = self.p[f"rec{way}"]
            state = np.zeros((n, h), np.float32)
            own = np.ascontiguousarray(gates[:, 3 * h * way : 3 * h * (way + 1)])
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                a = own[places[t]]
                u = state @ rec
                zr = _sigmoid(a[:, : 2 * h] + u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(a[:, 2 * h :] + r * u[:, 2 * h :])
                before = state
                state = before + mask[t] * (1 - z) * (new - before)
                states[t, :, h * way : h * (way + 1)] = state
                if keep:
                    trace.append((way, t, before, z, r, new, u[:, 2 * h :]))
        hidden = np.tanh(states.reshape(-1, 2 * h) @ self.p["att"] + self.p["att0"]).reshape(steps, n, -1)
        energy = np.where(mask[:, :, 0] > 0, hidden @ self.p["att1"], -1e9)
        weight = np.exp(energy - energy.max(axis=0)) * mask[:, :, 0]
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pool = np.einsum("tn,tnh->nh", weight, states)
        logit = pool @ self.p["out"] + self.p["out0"]
        return (logit, mask, states, trace, hidden, weight, pool) if keep else logit

    def gradients(self, texts: _Texts, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss of windows."""
        places = texts.places(windows)
        used, local = np.unique(places, return_inverse=True)
        local = local.reshape(places.shape)
        local = local - 1 if used[0] < 0 else local
        used = used[used >= 0]
        sub = _Subset(texts, used)
        x, gates = self.inputs(sub)
        logit, mask, states, trace, hidden, weight, pool = self.forward(gates, local, keep=True)
        h, n = _HIDDEN, len(windows)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = ((_sigmoid(logit) - labels) / n).astype(np.float32)
        g["out"], g["out0"] = pool.T @ d, d.sum(keepdims=True)
        d_pool = d[:, None] * self.p["out"]
        d_states = weight[:, :, None] * d_pool
        d_weight = np.einsum("nh,tnh->tn", d_pool, states)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att1"] = np.einsum("tn,tna->a", d_energy, hidden)
        d_hidden = (d_energy[:, :, None] * self.p["att1"] * (1 - hidden**2)).reshape(-1, _ATTENTION)
        flat = states.reshape(-1, 2 * h)
        g["att"], g["att0"] = flat.T @ d_hidden, d_hidden.sum(axis=0)
        d_states += (d_hidden @ self.p["att"].T).reshape(d_states.shape)
        d_gates = np.zeros_like(gates)
        carry = [np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)]
        for way, t, before, z, r, new, u in reversed(trace):
            d_after = carry[way] + d_states[t, :, h * way : h * (way + 1)]
            dm = d_after * mask[t]
            d_new = dm * (1 - z) * (1 - new**2)
            d_z = dm * (before - new) * z * (1 - z)
            d_r = d_new * u * r * (1 - r)
            da = np.concatenate([d_z, d_r, d_new], axis=1)
            du = np.concatenate([d_z, d_r, d_new * r], axis=1)
            g[f"rec{way}"] += before.T @ du
            carry[way] = d_after * (1 - mask[t]) + dm * z + du @ self.p[f"rec{way}"].T
            np.add.at(d_gates, (local[t], slice(3 * h * way, 3 * h * (way + 1))), da)
        d_gates = d_gates[:-1]  # the row for no word stays zero
        g["in"], g["in0"] = x.T @ d_gates, d_gates.sum(axis=0)
        dx = d_gates @ self.p["in"].T
        np.add.at(g["word"], sub.bucket, dx[:, :_DIM])
        count = sub.gram_count
        np.add.at(g["gram"], sub.gram, np.repeat(dx[:, _DIM:] / np.maximum(count, 1)[:, None], count, axis=0))
        return g

    def worst(self, texts: _Texts, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """Each text's largest logit, and the window that has it."""
        _, gates = self.inputs(texts)
        logit = np.zeros(len(texts.text), np.float32)
        for at in range(0, len(logit), block):
            some = np.arange(at, min(len(logit), at + block))
            logit[some] = self.forward(gates, texts.places(some))
        order = np.lexsort((-np.arange(len(logit)), logit, texts.text))
        last = order[np.flatnonzero(np.append(np.diff(texts.text[order]) > 0, len(order) > 0))]
        return logit[last], last

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit.astype(np.float64) + self.shift, -40, 40)))


class _Subset:
    """Some of the different words of texts, renumbered."""

    def __init__(self, texts: _Texts, used: np.ndarray):
        first = np.cumsum(texts.gram_count) - texts.gram_count
        self.bucket, self.gram_count = texts.bucket[used], texts.gram_count[used]
        self.gram = texts.gram[ragged_range(first[used], self.gram_count)]

    mean_of_grams = _Texts.mean_of_grams


def _log_odds(texts: _Texts, labels: np.ndarray, buckets: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Per bucket the smoothed log-odds of label 1 of the texts that have it."""
    yes, no = np.zeros(1 << _BITS), np.zeros(1 << _BITS)
    first = np.cumsum(owner) - owner
    for i in range(0, len(labels), _TEXTS_AT_ONCE):
        bounds = texts.first[i : i + _TEXTS_AT_ONCE + 1]
        word = texts.word[bounds[0] : bounds[-1]]
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        seen = buckets[ragged_range(first[word], owner[word])]
        both = np.unique((np.repeat(text, owner[word]) << _BITS) + seen)
        label, seen = labels[i + (both >> _BITS)], both & ((1 << _BITS) - 1)
        yes += np.bincount(seen, label, 1 << _BITS)
        no += np.bincount(seen, 1 - label, 1 << _BITS)
    return np.log((yes + 1) / (no + 1)) - np.log((labels.sum() + 2) / ((1 - labels).sum() + 2))


def train(texts: list[str], labels: np.ndarray, seed: int = 8) -> Network:
    """A network fitted on texts and their labels, a fifth of which calibrates it."""
    rng = np.random.default_rng(seed)
    net = Network(seed)
    labels = labels.astype(np.float64)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        net.slope, net.shift = 0.0, float(np.log(max(share, 1e-17) / max(1 - share, 1e-17)))
        return net
    held = rng.random(len(labels)) < 0.2
    buf, bounds = text_bytes(pa.array([t or "" for t, out in zip(texts, held, strict=True) if not out], pa.large_string()))
    own, target = _Texts(buf, bounds), labels[~held]
    odds = _log_odds(own, target, own.bucket, np.ones(len(own.bucket), np.int64)), _log_odds(own, target, own.gram, own.gram_count)
    net.p["word"][:, 0] = np.clip(odds[0], -4, 4) / 4
    net.p["gram"][:, 0] = np.clip(odds[1], -4, 4) / 4
    worst = _worst_by_odds(own, odds)
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    n = 0
    for epoch in range(_EPOCHS):
        if epoch:
            worst = net.worst(own)[1]
        windows = np.concatenate([worst, rng.integers(0, len(own.text), len(worst) // 2)])
        windows = windows[(target[own.text[windows]] == 0) | np.isin(windows, worst)]
        for part in np.array_split(rng.permutation(windows), max(1, len(windows) // _BATCH)):
            n += 1
            for k, g in net.gradients(own, part, target[own.text[part]]).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                net.p[k] -= _RATE * (mean[k] / (1 - 0.9**n)) / (np.sqrt(square[k] / (1 - 0.99**n)) + 1e-6)
    buf, bounds = text_bytes(pa.array([t or "" for t, out in zip(texts, held, strict=True) if out], pa.large_string()))
    net.slope, net.shift = _calibrate(net.worst(_Texts(buf, bounds))[0].astype(np.float64), labels[held]) if held.any() else (1.0, 0.0)
    return net


def _worst_by_odds(texts: _Texts, odds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Each text's window with the word of the highest odds."""
    word = np.append(odds[0][texts.bucket] + texts.mean_of_grams(odds[1][:, None])[:, 0], -1e9)
    most = np.concatenate([word[texts.places(np.arange(a, min(len(texts.text), a + 8192)))].max(axis=0) for a in range(0, len(texts.text), 8192)])
    order = np.lexsort((most, texts.text))
    return order[np.flatnonzero(np.append(np.diff(texts.text[order]) > 0, True))]


def _calibrate(logit: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of labels, with labels drawn in a little so that it stays finite."""
    yes, no = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (p - target))
        w -= np.clip(step, -1, 1)
    return float(w[0]), float(w[1])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, size: int = SAMPLE_BYTES) -> pd.DataFrame:
    """At most `rows` labelled texts of each class, those with the smallest hash of their id; of several texts of one id
    the first in order.  Texts, always whole, are taken in that order while they fit `size` bytes together; one that takes
    more than the LONG_SHARE-th part of those by itself is passed over, so that it does not keep the others out."""
    chosen = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    some = [chosen.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)]
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = text.join(F.broadcast(some[0].union(some[1])), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    # at most `rows` rows a class
    found = found.where(F.octet_length("text") * LONG_SHARE <= size)
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("size", before).where(F.col("size") <= size).select("id", "text", "label").toPandas().sort_values("id", kind="stable")


def scores(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row per row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = text_bytes(text_array(batch.column(1)))
            out = np.zeros(batch.num_rows)
            for i, j in chunks(bounds, 1 << 20):
                texts = _Texts(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                out[i:j] = shared.value.score(shared.value.worst(texts)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE, folds: int = 3, fold: int = 1) -> DataFrame:
    """(id, held_out, score, predicted): one row per row of docs.

    Ids whose crc32 as text leaves `fold` modulo `folds` are held out: their labels are not read.
    """
    held_out = F.crc32(F.col("id").cast("string")) % folds == fold
    known = labels.withColumn("id", F.col(id_col)).where(F.col("id").isNotNull() & ~held_out).select(id_col, label_col)
    data = sample(docs, known, id_col, text_col, label_col, rows)
    net = train(data["text"].tolist(), data["label"].to_numpy())
    found = scores(docs, net, id_col, text_col)
    return found.select("id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
