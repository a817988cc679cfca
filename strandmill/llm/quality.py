"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of bytes, trained on trusted text.

All trusted documents but a held-out fifth give the counts of their runs of `ORDER` bytes; lower orders are
continuation counts, derived from those by grouping, and each order has its own three discounts from its counts of
counts.  All tables stay distributed.  A block of documents sends each different run of bytes in it once to a hash
shard; in each shard the different runs are joined with the counts and context totals of every order, and the
log-probabilities go back to the blocks, which sum them per document.  Perplexity is per byte.

A document is accepted if its log-perplexity exceeds the median of its language's held-out trusted documents by no more
than a quantile of theirs.  Means over few bytes vary more, so excesses are weighted: their variance is taken as one part
that falls with the bytes and one that does not (documents also differ as wholes), and where the two are equal is fitted
to the held-out documents.  The quantile, LEVEL, lies far out, where some "trusted" documents are not what their label
says; so it is worked out from the quantile at TAIL, excesses beyond being taken as exponential.  A language with under
LEAST_OWN held-out documents takes the quantile of all languages, one with none also the median of all.  With no trusted
document at all, every byte has the same probability and nothing but documents without text is rejected.

Null and empty texts have null perplexity and are rejected.  A null language is a language of its own.  Repeated rows
each get a row; an id is trusted if any of its labels says so.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm._bytes import chunks, text_array, text_bytes
from strandmill.llm._shared import block_of, number_of_blocks, packed_blocks, unpacked, written

ORDER = 5
#: The share of trusted documents that passes, and the quantile from which that one is worked out.
LEVEL, TAIL = 0.999, 0.9
#: Bytes at which both parts of the variance are equal, where held-out documents are too alike in length to tell.
FULL_BYTES = 4096
#: Fewer excesses than LEAST_OWN do not give a quantile of their own; LEAST_SPREAD is the least value of a quantile.
LEAST_OWN, LEAST_SPREAD = 20, 0.5
HELD_OUT = 5
#: Least discount of a run seen once; twice and three times that for runs seen twice and more.
LEAST_DISCOUNT = 0.1
BLOCK_ROWS = 2048
_CHUNK = 1 << 20
_SLOT_BITS = 20
_CELLS = "bucket int, block int, data binary"


def _runs(buf: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """The `order` bytes that end at each byte, as a number; zero bytes stand before a text."""
    out = buf.astype(np.uint64)
    starts, ends = bounds[:-1], bounds[1:]
    for back in range(1, order):
        shifted = np.zeros(len(buf), np.uint64)
        shifted[back:] = buf[: max(0, len(buf) - back)]
        for k in range(back):
            at = starts + k
            shifted[at[at < ends]] = 0
        out |= shifted << np.uint64(8 * back)
    return out


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    at = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
    return codes[at], np.diff(np.append(at, len(codes)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    at = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1]) if len(codes) else np.zeros(0, int)
    return codes[at], np.add.reduceat(counts, at) if len(at) else counts


def _block_runs(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of a block's texts, in order, and how often each occurs."""
    buf, bounds = text_bytes(texts)
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for i, j in chunks(bounds, _CHUNK):
        parts.append(_counted(_runs(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], order)))
        if len(parts) > 8:
            parts = [_merged(parts)]
    return _merged(parts)


def _training(order: int):
    def run(cells: pa.Table, trusted: pa.Table) -> pa.Table:
        rows = unpacked(cells) if trusted.num_rows and cells.num_rows else pa.table({"id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
        own = rows.filter(pc.is_in(rows.column("id"), trusted.column("id").combine_chunks())) if trusted.num_rows else rows.slice(0, 0)
        codes, counts = _block_runs(text_array(own.column("text")), order)
        return pa.table({"gram": codes.view(np.int64), "n": counts})

    return run


def _asked(order: int, buckets: int):
    def run(cells: pa.Table) -> pa.Table:
        codes, _ = _block_runs(text_array(unpacked(cells).column("text")), order)
        bucket = _bucket(codes, buckets)
        by = np.argsort(bucket, kind="stable")
        codes, bucket = codes[by], bucket[by]
        at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist() if len(bucket) else [0]
        block = cells.column("block")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array([int(bucket[a]) for a in at[:-1]], pa.int32()),
                "block": pa.array([block] * (len(at) - 1), pa.int32()),
                "data": pa.array([_shrunk(codes[a:b]) for a, b in itertools.pairwise(at)], pa.binary()),
            }
        )

    return run


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _shrunk(codes: np.ndarray) -> bytes:
    """Ascending numbers, as their differences byte by byte: the upper bytes of those are zero, and compress."""
    steps = np.diff(codes, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _grown(data: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(steps.T).view("<u8").ravel(), dtype=np.uint64)


def _different(cells: pa.Table) -> pa.Table:
    codes = np.unique(np.concatenate([_grown(x.as_py()) for x in cells.column("data")]))
    return pa.table({"gram": codes.view(np.int64), "bucket": pa.array(np.full(len(codes), cells.column("bucket")[0].as_py(), np.int32))})


def _answered(cells: pa.Table, known: pa.Table) -> pa.Table:
    """The log-probabilities of each cell's runs, in their order."""
    order = np.argsort(known.column("gram").to_numpy())
    codes, logs = known.column("gram").to_numpy()[order].view(np.uint64), known.column("log").to_numpy()[order].astype("<f4")
    found = [_grown(x.as_py()) for x in cells.column("data")]
    return pa.table(
        {
            "block": cells.column("block"),
            "codes": cells.column("data"),
            "logs": pa.array([logs[np.searchsorted(codes, x)].tobytes() for x in found], pa.binary()),
        }
    )


def _scored(order: int, carried: list[str]):
    def run(cells: pa.Table, answers: pa.Table) -> pa.Table:
        rows = unpacked(cells)
        codes = np.concatenate([np.zeros(0, np.uint64), *(_grown(x.as_py()) for x in answers.column("codes"))])
        logs = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(x.as_py(), "<f4") for x in answers.column("logs"))])
        by = np.argsort(codes)
        codes, logs = codes[by], logs[by]
        slot = lambda c: (c * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        table = np.zeros(1 << _SLOT_BITS, np.int32)
        table[slot(codes)] = np.arange(len(codes))
        buf, bounds = text_bytes(text_array(rows.column("text")))
        total = np.zeros(rows.num_rows)
        for i, j in chunks(bounds, _CHUNK):
            own = bounds[i : j + 1] - bounds[i]
            asked = _runs(buf[bounds[i] : bounds[j]], own, order)
            if not len(asked):
                continue
            at = table[slot(asked)]
            lost = np.flatnonzero(codes[at] != asked)
            at[lost] = np.searchsorted(codes, asked[lost])
            sums = np.concatenate([[0.0], np.cumsum(logs[at], dtype=np.float64)])
            total[i:j] = sums[own[1:]] - sums[own[:-1]]
        size = np.diff(bounds)
        worth = np.exp(-total / np.maximum(size, 1))
        out = {"id": rows.column("id"), "lang": rows.column("lang"), "n_bytes": pa.array(size), "perplexity": pa.array(worth, mask=size == 0)}
        return pa.table(out | {f"carried{k}": rows.column(c) for k, c in enumerate(carried)})

    return run


def _discounts(levels: dict[int, DataFrame]) -> dict[int, tuple[float, float, float]]:
    """Each order's discounts of counts 1, 2 and 3 or more, from its counts of counts: five small rows."""
    tallies = [df.agg(F.lit(k).alias("k"), *(F.count_if(F.col("n") == c).alias(f"n{c}") for c in (1, 2, 3, 4))) for k, df in levels.items()]
    every = tallies[0]
    for t in tallies[1:]:
        every = every.union(t)
    out = {}
    for row in every.collect():
        n1, n2, n3, n4 = row.n1, row.n2, row.n3, row.n4
        if not (n1 and n2 and n3):
            out[row.k] = (0.5, 1.0, 1.5)
            continue
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        # where few runs decide, the estimates can leave their range; something must stay for runs not seen
        out[row.k] = tuple(min(max(d, LEAST_DISCOUNT * k), float(k)) for k, d in enumerate(raw, 1))
    return out


def probabilities(asked: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """The columns of asked, and log: log-probability of the last byte of `gram` after those before it.

    counts has (gram, n) of the trusted text.
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        levels[k] = levels[k + 1].groupBy(suffix.alias("gram")).agg(F.count("*").alias("n"))
    discounts = _discounts(levels)

    def discount(k: int, n: Column) -> Column:
        d1, d2, d3 = discounts[k]
        return F.when(n == 1, F.lit(d1)).when(n == 2, F.lit(d2)).otherwise(F.lit(d3))

    columns = asked.columns
    out = asked.withColumn("p", F.lit(1 / 256))
    for k in range(1, order + 1):
        seen = levels[k].select(F.col("gram").alias("g"), (F.col("n") - discount(k, F.col("n"))).alias("own"))
        context = levels[k].groupBy(F.shiftright("gram", 8).alias("c")).agg(F.sum("n").alias("total"), F.sum(discount(k, F.col("n"))).alias("freed"))
        if k <= 2:  # at most 256 ** k rows
            seen = F.broadcast(seen)
        if k <= 3:  # at most 256 ** (k - 1) rows, some of which stand before a good part of all runs
            context = F.broadcast(context)
        out = out.withColumn("g", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).withColumn("c", F.shiftright("g", 8))
        out = out.join(seen, "g", "left").join(context, "c", "left")
        better = (F.coalesce("own", F.lit(0.0)) + F.col("freed") * F.col("p")) / F.col("total")
        out = out.select(*columns, F.coalesce(better, F.col("p")).alias("p"))
    return out.select(*columns, F.log("p").cast("float").alias("log"))


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, held_out: int = HELD_OUT, block_rows: int = BLOCK_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang, n_bytes, perplexity, carried0, ...): one row per row of docs, with the columns named in carry.

    trusted has the ids, as `id`, of trusted documents.  Those whose crc32 as text is divisible by held_out do not
    train the model (0: all train it).
    """
    blocks = number_of_blocks(docs, block_rows, text_col)
    more = [F.col(c).alias(f"carried{k}") for k, c in enumerate(carry) if c != text_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), *more)
    texts = packed_blocks(rows.withColumn("block", block_of(F.col("id"), blocks))).groupBy("block")
    train = trusted.where(F.col("id").isNotNull() & ~_is_held_out(held_out)).distinct().withColumn("block", block_of(F.col("id"), blocks)).groupBy("block")
    counts = texts.cogroup(train).applyInArrow(_training(order), "gram long, n long")
    counts = written(counts.groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")
    cells = texts.applyInArrow(_asked(order, blocks), _CELLS)
    different = cells.groupBy("bucket").applyInArrow(_different, "gram long, bucket int")
    known = probabilities(different, counts, order)
    answers = cells.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_answered, "block int, codes binary, logs binary")
    ids, langs = (docs.schema[c].dataType.simpleString() for c in (id_col, lang_col))
    kind = f"id {ids}, lang {langs}, n_bytes long, perplexity double" + "".join(f", carried{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    return texts.cogroup(answers.groupBy("block")).applyInArrow(_scored(order, ["text" if c == text_col else f"carried{k}" for k, c in enumerate(carry)]), kind)


def _is_held_out(held_out: int) -> Column:
    return F.crc32(F.col("id").cast("string")) % held_out == 0 if held_out else F.lit(False)


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", level: float = LEVEL, held_out: int = HELD_OUT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang, n_bytes, perplexity, threshold, accepted, carried0, ...): one row per row of docs.

    Thresholds are broadcast: one row for each language, of which there are some thousands at most.
    """
    # written, as the thresholds and the result both read it
    scored = written(perplexities(docs, trusted, id_col, text_col, lang_col, held_out=held_out, carry=carry), "perplexities")
    calibrating = (trusted.where(_is_held_out(held_out)) if held_out else trusted).distinct()
    sample = scored.select("id", "lang", "n_bytes", "perplexity").join(calibrating, "id", "left_semi").where("perplexity is not null")
    excess = written(_excesses(sample), "excesses")
    full = _full_bytes(excess)
    cuts = _cuts(excess, full)
    same = F.col("lang").eqNullSafe(F.col("of"))
    out = scored.join(F.broadcast(cuts.where("not every").drop("every")), same, "left").withColumn("one", F.lit(1))
    overall = cuts.where("every").select(F.col("centre").alias("any"), F.col("spread").alias("any_spread"), F.lit(1).alias("one"))
    out = out.join(F.broadcast(overall), "one", "left")
    spread = F.greatest(F.when(F.col("n") >= LEAST_OWN, F.col("spread")).otherwise(F.col("any_spread")), F.lit(LEAST_SPREAD))
    beyond = math.log(0.5 / (1 - level)) / math.log(0.5 / (1 - TAIL))  # of an exponential distribution's quantiles
    out = out.withColumn("threshold", F.exp(F.coalesce("centre", "any") + beyond * spread / _weight(full)))
    accepted = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("id", "lang", "n_bytes", "perplexity", "threshold", accepted.alias("accepted"), *[f"carried{k}" for k in range(len(carry))])


def _weight(full: float) -> Column:
    n = F.greatest(F.col("n_bytes"), F.lit(1)).cast("double")  # texts without bytes are rejected all the same
    return F.sqrt(n * full / (n + full))


def _excesses(sample: DataFrame) -> DataFrame:
    """(of, n_bytes, log, e): log-perplexities and what they exceed their language's median by."""
    rows = sample.select(F.col("lang").alias("of"), "n_bytes", F.log("perplexity").alias("log"))
    middle = rows.groupBy("of").agg(F.percentile_approx("log", 0.5, 10_000).alias("middle")).withColumnRenamed("of", "its")
    return rows.join(F.broadcast(middle), F.col("of").eqNullSafe(F.col("its"))).select("of", "n_bytes", "log", (F.col("log") - F.col("middle")).alias("e"))


def _full_bytes(excess: DataFrame) -> float:
    """Bytes at which the part of the variance that falls with them equals the other one, from the typical excesses
    of the shortest and the longest quarter."""
    ends = excess.agg(F.percentile_approx("n_bytes", [0.25, 0.75], 10_000)).first()[0]
    if not ends or ends[0] == ends[1]:
        return FULL_BYTES
    short, long = F.col("n_bytes") <= ends[0], F.col("n_bytes") >= ends[1]
    typical = lambda which: F.percentile_approx(F.when(which, F.abs("e")), 0.5, 10_000)
    row = excess.agg(*(f for which in (short, long) for f in (typical(which), F.avg(F.when(which, 1 / F.col("n_bytes")))))).first()
    falling = (row[0] ** 2 - row[2] ** 2) / (row[1] - row[3])
    other = row[2] ** 2 - falling * row[3]
    if falling <= 0:
        return 1.0  # length does not matter
    return min(max(falling / other, 1.0), 2.0**40) if other > 0 else 2.0**40


def _cuts(excess: DataFrame, full: float) -> DataFrame:
    """(every, of, n, centre, spread): medians and weighted excesses at TAIL, a row for each language and one for all."""
    weighted = excess.withColumn("z", F.col("e") * _weight(full))
    measures = F.count("*").alias("n"), F.percentile_approx("log", 0.5, 10_000).alias("centre"), F.percentile_approx("z", TAIL, 10_000).alias("spread")
    own = weighted.groupBy("of").agg(*measures).select(F.lit(False).alias("every"), "of", "n", "centre", "spread")
    return own.union(weighted.agg(*measures).select(F.lit(True), F.lit(None), "n", "centre", "spread"))


def keep_accepted(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", level: float = LEVEL) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier accepts."""
    found = classify(docs, trusted, id_col, text_col, lang_col, level, carry=tuple(docs.columns)).where("accepted")
    return found.select(*[F.col(f"carried{k}").alias(c) for k, c in enumerate(docs.columns)])
