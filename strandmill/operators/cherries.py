"""Trees from alignments alone: sequences are paired by dividing, pairs' distances and site rates by coordinate ascent."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.grid import grid, initial_rate_weights, log_gamma_prior, site_rate_grid
from strandmill.functions.markov import expm_many
from strandmill.functions.ranks import with_position
from strandmill.functions.storage import BROADCAST_BYTES, few, written


def _distances(codes: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Share of differing sites of each row to one row, over sites where both are known; 0 without such sites."""
    both = (codes >= 0) & (to >= 0)
    n = both.sum(axis=1)
    return ((codes != to) & both).sum(axis=1) / np.maximum(n, 1)


def pair_sequences(codes: np.ndarray, rng: np.random.Generator) -> tuple[list[tuple[int, int]], int | None]:
    """Pairs of similar rows, all rows but one at most, and the row left over.

    A set is divided by which of two far rows is nearer; halves are paired first and what each leaves over is paired.
    Works through a list of open sets, so rows that peel off one by one need no deep recursion.
    """
    pairs: list[tuple[int, int]] = []
    left: list[int | None] = []
    work: list[np.ndarray | None] = [np.arange(len(codes))]
    while work:
        rows = work.pop()
        if rows is None:  # both halves are done: join what they leave over
            a, b = left.pop(), left.pop()
            if a is not None and b is not None:
                pairs.append((b, a))
                left.append(None)
            else:
                left.append(a if b is None else b)
        elif len(rows) == 2:
            pairs.append((int(rows[0]), int(rows[1])))
            left.append(None)
        elif len(rows) < 2:
            left.append(int(rows[0]) if len(rows) else None)
        else:
            own = codes[rows]
            x = int(_distances(own, own[rng.integers(len(rows))]).argmax())
            to_x = _distances(own, own[x])
            y = int(to_x.argmax())
            near_x = to_x <= _distances(own, own[y])
            near_x[y] = False
            work += [None, rows[~near_x], rows[near_x]]
    return pairs, left[0] if left else None


def _halving(n: int, most: int, value: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Where each of n functions over 0 to most - 1 with one maximum has it."""
    low, high = np.zeros(n, np.int64), np.full(n, most - 1)
    while (low < high).any():
        mid = np.minimum(low + (high - low) // 2, most - 1)
        up = np.minimum(mid + 1, most - 1)
        here = value(mid)
        there = value(up)
        open_ = low < high
        down = open_ & (here > there)
        high = np.where(down, mid, high)
        low = np.where(open_ & ~down, mid + 1, low)
    return low


def best_lengths(first: np.ndarray, second: np.ndarray, logs: np.ndarray, category: np.ndarray) -> np.ndarray:
    """Indices of the best length of each pair, given sites' rates."""
    known = (first >= 0) & (second >= 0)
    pair, site = np.nonzero(known)
    x, y = first[known], second[known]
    return _halving(len(first), logs.shape[0], lambda k: np.bincount(pair, logs[k[pair], category[site], x, y], len(first)))


def lengths_and_sums(first: np.ndarray, second: np.ndarray, logs: np.ndarray, category: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """best_lengths(), and (sites, rates): log-likelihoods of each site at each rate, with those lengths."""
    lengths = best_lengths(first, second, logs, category)
    known = (first >= 0) & (second >= 0)
    pair, site = np.nonzero(known)
    x, y = first[known], second[known]
    sums = [np.bincount(site, logs[lengths[pair], k, x, y], first.shape[1]) for k in range(logs.shape[1])]
    return lengths, np.stack(sums, axis=1)


def best_rates(sums: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Indices of the best rate of each site from lengths_and_sums()'s table."""
    site = np.arange(len(sums))
    return _halving(len(sums), sums.shape[1], lambda k: prior[k] + sums[site, k])


def lengths_and_rates(first: np.ndarray, second: np.ndarray, logs: np.ndarray, category: np.ndarray, prior: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the best length of each pair and the best rate of each site, in turn until lengths stay.

    logs: (lengths, rates, x, y), both directions added; likelihoods have one maximum over lengths and over rates,
    which is sought by halving.
    """
    known = (first >= 0) & (second >= 0)
    pair, site = np.nonzero(known)
    x, y = first[known], second[known]
    lengths = best_lengths(first, second, logs, category)
    for _ in range(rounds):
        category = _halving(first.shape[1], logs.shape[1], lambda k: prior[k] + np.bincount(site, logs[lengths[pair], k[site], x, y], first.shape[1]))  # noqa: B023
        again = best_lengths(first, second, logs, category)
        if (again == lengths).all():
            break
        lengths = again
    return lengths, category


def state_counts(codes: np.ndarray, n_states: int) -> np.ndarray:
    """(states, sites): how often each state is seen at a site."""
    return np.stack([(codes == s).sum(axis=0) for s in range(n_states)])


def initial_categories(seen: np.ndarray, weights: list[float]) -> np.ndarray:
    """Sites in order of variability dealt to ascending rates by the shares of the prior; seen: state_counts()."""
    n_sites = seen.shape[1]
    variability = ((seen.sum(axis=0) - seen) * seen).sum(axis=0)
    out, now = np.zeros(n_sites, np.int64), 0
    for rank, site in enumerate(np.lexsort((np.arange(n_sites), variability))):
        if now < len(weights) - 1 and rank >= np.floor(weights[now] * n_sites + 0.5):
            now += 1
        out[site] = now
    return out


def encoded(seqs: list[str | None], states: list[str], width: int) -> np.ndarray:
    """Places of sequences' characters among the states, -1 for what is no state, beyond a sequence's end or of none."""
    out = np.full((len(seqs), width), -1, np.int8)
    for row, s in zip(out, seqs, strict=True):
        letters = np.frombuffer((s or "")[:width].encode("utf-32-le"), np.uint32)
        own = row[: len(letters)]
        for k, c in enumerate(states):
            own[letters == ord(c)] = k
    return out


@dataclass
class _Model:
    """What pairs' lengths and sites' rates are looked up in."""

    states: list[str]
    points: list[float]
    rates: np.ndarray
    logs: np.ndarray
    prior: np.ndarray
    weights: list[float]
    rounds: int
    seed: int


#: Rows of a set of sequences, and sites of a family in all, that are a group.
WHOLE_SET, WHOLE_SITES = 1 << 14, 1 << 24
#: Rows of small sets, about, that are paired as one group.
GROUP_ROWS = 1 << 12
#: From this round on sets are halved whatever their shape.
HALVED = 24


def fast_cherries(msa: DataFrame, states: list[str], q: np.ndarray, points: list[float] | None = None, n_rates: int = 20, rounds: int = 50, seed: int = 0, whole: int = WHOLE_SITES, whole_set: int = WHOLE_SET) -> tuple[DataFrame, DataFrame]:
    """Edges (family, parent, child, child_ord, length) of star trees of cherries, and rates (family, rates).

    Each pair hangs under a node of its own, half of its distance on either side; an odd sequence hangs under the root.
    Site rates have mean 1.  A family is as wide as its longest sequence; what others lack, and null sequences, are missing.

    A family of up to `whole` residues is a group.  Larger ones are divided in rounds over all rows until no set has more
    than `whole_set` of them; lengths and rates then take turns in passes over the pairs.
    """
    points = grid() if points is None else points
    rates = np.array(site_rate_grid(n_rates))
    logs = np.log(np.maximum(expm_many(q, np.outer(points, rates).ravel()), 1e-300)).reshape(len(points), len(rates), len(states), len(states))
    logs = logs + np.swapaxes(logs, 2, 3)
    prior, weights = np.array([log_gamma_prior(r) for r in rates]), initial_rate_weights(list(rates))
    model = _Model(states, list(points), rates, logs, prior, weights, rounds, seed)
    shared = msa.sparkSession.sparkContext.broadcast(model)
    kind = msa.schema["family"].dataType.simpleString()
    sizes = msa.groupBy("family").agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("width"))
    large = sizes.where(F.col("n") * F.col("width") > whole)
    any_large = not large.isEmpty()
    small = msa.join(large.select("family"), "family", "left_anti") if any_large else msa

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, m = group.sort_values("seq_name", kind="stable"), shared.value
        family, names = group["family"].iloc[0], group["seq_name"].astype(str).tolist()
        seqs = group["seq"].where(group["seq"].notna(), None).tolist()
        codes = encoded(seqs, m.states, max((len(s) for s in seqs if s is not None), default=0)).astype(np.int64)
        pairs, odd = pair_sequences(codes, np.random.default_rng([m.seed, zlib.crc32(str(family).encode())]))
        rows = []
        found = np.ones(codes.shape[1])
        if pairs:
            a, b = np.array(pairs).T
            lengths, category = lengths_and_rates(codes[a], codes[b], m.logs, initial_categories(state_counts(codes, len(m.states)), m.weights), m.prior, m.rounds)
            found = m.rates[category]
            mean = found.mean() if len(found) else 1.0
            found = found / mean
            for k, (i, j) in enumerate(pairs):
                half = m.points[lengths[k]] * mean / 2
                rows += [("root", f"internal-{k}", k, 1.0), (f"internal-{k}", names[i], 0, half), (f"internal-{k}", names[j], 1, half)]
        if odd is not None:
            rows.append(("root", names[odd], len(pairs), 1.0))
        out = pd.DataFrame(rows, columns=["parent", "child", "child_ord", "length"])
        out.insert(0, "family", family)
        out["rates"] = [found.tolist() if k == 0 else None for k in range(len(out))]
        return out

    both = small.groupBy("family").applyInPandas(run, f"family {kind}, parent string, child string, child_ord int, length double, rates array<double>")
    both = both.persist(StorageLevel.DISK_ONLY)  # edges and rates are read apart; a lost part is made again, with the same draws
    edges, found = both.drop("rates"), both.where("rates is not null").select("family", F.col("rates"))
    if any_large:
        more, more_rates = _in_rounds(msa.join(few(large.select("family", "width")), "family"), model, whole_set)
        edges, found = edges.unionByName(more), found.unionByName(more_rates)
    return edges, found


#: Bytes of sequences that are compared at once.
COMPARED_BYTES = 1 << 24


def _apart(codes: pd.Series, to: pd.Series) -> np.ndarray:
    """_distances() of rows, each to its own, whatever their families: all rows of a length at once."""
    out = np.empty(len(codes))
    for width, at in codes.groupby(codes.str.len().to_numpy(), sort=False).indices.items():
        for rows in np.array_split(at, -(-len(at) * int(width) // COMPARED_BYTES) or 1):
            a, b = (np.frombuffer(b"".join(x.iloc[rows]), np.int8).reshape(len(rows), -1) for x in (codes, to))
            both = (a >= 0) & (b >= 0)
            out[rows] = ((a != b) & both).sum(axis=1) / np.maximum(both.sum(axis=1), 1)
    return out


def _best(rows: DataFrame, kind: str) -> DataFrame:
    """(family, set, k, codes, d, to, n) of the row with the largest d, the smallest k of equals, of each set of n rows.

    rows: (family, set, k, codes, to or null, draw); d is the distance to `to`, or the draw.  Each batch sends its best only.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            d = batch["draw"] if batch["to"].isna().all() else _apart(batch["codes"], batch["to"])
            n = batch.groupby(["family", "set"], sort=False)["k"].transform("size")
            batch = batch.assign(d=d, n=n).sort_values(["d", "k"], ascending=[False, True], kind="stable")
            yield batch.drop_duplicates(["family", "set"])[["family", "set", "k", "codes", "d", "to", "n"]]

    some = rows.select("family", "set", "k", "codes", "to", "draw").mapInPandas(run, f"family {kind}, set string, k long, codes binary, d double, to binary, n long")
    best = F.max(F.struct("d", (-F.col("k")).alias("o"), "codes", "to"))
    return some.groupBy("family", "set").agg(best.alias("b"), F.sum("n").alias("n")).select("family", "set", (-F.col("b.o")).alias("k"), "b.codes", "b.d", "b.to", "n")


def _divided(rows: DataFrame, model: _Model, whole_set: int, kind: str) -> list[DataFrame]:
    """Tables of (family, k, codes, set), together the rows (family, k, codes); no set is larger than whole_set.

    A set's name is its way through the divisions, 0 for nearer to the first of its two far rows.  Rows that do not differ
    are halved by a hash, and so is, at the middle of what divides it, any set from round HALVED on, as outliers may peel off one at
    a time.  A round writes two tables: sets with their sizes and a row drawn from each, and the rows with their new
    sets, for which the far rows are found on the way.
    """
    done: list[DataFrame] = []
    now = written(rows.withColumn("set", F.lit("")), "sets")
    width = 100 + 3 * (now.agg(F.max(F.octet_length("codes"))).first()[0] or 0)

    @F.pandas_udf("double")
    def lean(codes: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_apart(codes, x) - _apart(codes, y))

    for k in range(1 << 16):
        draw = F.xxhash64("k", F.lit(model.seed), F.lit(k)).cast("double")
        drawn = written(_best(now.withColumns({"to": F.lit(None).cast("binary"), "draw": draw}), kind), "drawn")
        open_ = drawn.where(F.col("n") > whole_set)
        size = open_.count()
        if not size:
            return [*done, now]
        mark = F.broadcast if size * width <= BROADCAST_BYTES else lambda df: df  # as few(); all that follows has a row a set
        done.append(now.join(mark(open_.select("family", "set")), ["family", "set"], "left_anti"))
        given = lambda ends: now.join(mark(ends.select("family", "set", F.col("codes").alias("to"))), ["family", "set"]).withColumn("draw", F.lit(0.0))  # noqa: B023, E731
        far = _best(given(_best(given(open_), kind)), kind)  # y, and x as what it is far from
        far = far.select("family", "set", F.col("to").alias("x"), F.col("codes").alias("y"), F.col("k").alias("y_at"), F.col("d").alias("apart"))
        by = now.join(mark(far), ["family", "set"])
        by = by.withColumn("lean", F.when(F.col("apart") == 0, F.pmod(F.xxhash64("k", F.lit(k)), F.lit(1 << 20)).cast("double")).otherwise(lean("codes", "x", "y")))
        by = by.select("family", "k", "codes", "set", "lean", "apart", "y_at")
        if k >= HALVED:
            by = written(by, "leaning")
            middle = by.groupBy("family", "set").agg(F.percentile_approx("lean", 0.5, 1000).alias("middle"))
            by = by.join(mark(middle), ["family", "set"]).withColumn("first", F.when(F.col("lean") == F.col("middle"), F.xxhash64("k", F.lit(k)) > 0).otherwise(F.col("lean") < F.col("middle")))
        else:
            by = by.withColumn("first", F.when(F.col("apart") == 0, F.col("lean") < (1 << 19)).otherwise((F.col("lean") <= 0) & (F.col("k") != F.col("y_at"))))
        now = written(by.select("family", "k", "codes", F.concat("set", F.when(F.col("first"), "0").otherwise("1")).alias("set")), "sets")
    raise ValueError("sets of sequences cannot be divided")


def _paired(sets: DataFrame, model: _Model, kind: str) -> tuple[DataFrame, DataFrame]:
    """(family, a, b) by k, and (family, k) of what is left over in a family.

    Small sets share a group, so that groups and their cost follow rows and not sets.
    """
    seed = model.seed

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["family", "set", "k"], kind="stable")
        k, codes = group["k"].to_numpy(), group["codes"].to_numpy()
        families, names, firsts, seconds = [], [], [], []
        for (family, name), at in group.groupby(["family", "set"], sort=False).indices.items():
            own = np.frombuffer(b"".join(codes[at]), np.int8).reshape(len(at), -1)
            pairs, odd = pair_sequences(own, np.random.default_rng([seed, zlib.crc32(f"{family}/{name}".encode())]))
            firsts += [k[at[i]] for i, _ in pairs] + ([] if odd is None else [k[at[odd]]])
            seconds += [k[at[j]] for _, j in pairs] + ([] if odd is None else [None])
            families += [family] * (len(firsts) - len(families))
            names += [name] * (len(firsts) - len(names))
        return pd.DataFrame({"family": families, "set": names, "a": pd.array(firsts, "Int64"), "b": pd.array(seconds, "Int64")})

    parts = -(-sets.count() // GROUP_ROWS) or 1
    dealt = sets.withColumn("part", F.pmod(F.xxhash64("family", "set"), F.lit(parts))).repartition(parts, "part")
    found = written(dealt.groupBy("part").applyInPandas(run, f"family {kind}, set string, a long, b long"), "pairs")

    def up(group: pd.DataFrame) -> pd.DataFrame:
        """Leftovers of a family's sets, one of each at most, meet where their ways part."""
        left = dict(zip(group["set"], group["a"], strict=True))
        rows = []
        for depth in range(max(map(len, left)), 0, -1):
            for name in sorted(n for n in left if len(n) == depth and n in left):
                if name not in left:
                    continue
                k, other = left.pop(name), left.pop(name[:-1] + "10"[int(name[-1])], None)
                if other is None:
                    left[name[:-1]] = k
                else:
                    rows.append((k, other))
        rows += [(k, None) for k in left.values()]
        out = pd.DataFrame(rows, columns=["a", "b"]).astype("Int64")
        out.insert(0, "family", group["family"].iloc[0])
        return out

    rest = written(found.where("b is null").groupBy("family").applyInPandas(up, f"family {kind}, a long, b long"), "leftovers")
    pairs = found.where("b is not null").select("family", "a", "b").unionByName(rest.where("b is not null"))
    return pairs, rest.where("b is null").select("family", F.col("a").alias("k"))


def _summed(tables: DataFrame, kind: str, what) -> DataFrame:
    """(family, category), binary: what(sum of a family's tables); each task has sent one at most for a family and batch."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float64) for x in group["data"]], axis=0)
        return pd.DataFrame({"family": [group["family"].iloc[0]], "category": [what(total).astype(np.int64).tobytes()]})

    return written(tables.groupBy("family").applyInPandas(run, f"family {kind}, category binary"), "categories")


def _in_rounds(msa: DataFrame, model: _Model, whole_set: int) -> tuple[DataFrame, DataFrame]:
    """fast_cherries() of families (family, width, seq_name, seq) too large for a group."""
    kind, spark = msa.schema["family"].dataType.simpleString(), msa.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("binary")
    def codes_of(seq: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([encoded([s], shared.value.states, w)[0].tobytes() for s, w in zip(seq, width, strict=True)])

    named = with_position(msa.select("family", F.col("seq_name").cast("string").alias("seq_name"), "seq", "width"), "family", "seq_name", "seq")
    rows = written(named.select("family", "seq_name", F.col("position").alias("k"), codes_of("seq", "width").alias("codes")), "sequences")
    own = rows.select("family", "k", "codes")
    divided = _divided(own, model, whole_set, kind)
    sets = divided[0]
    for more in divided[1:]:
        sets = sets.unionByName(more)
    pairs, odd = _paired(sets, model, kind)
    side = lambda c: own.select("family", F.col("k").alias(c), F.col("codes").alias(f"{c}_codes"))
    numbered = with_position(pairs, "family", "a")
    numbered = numbered.join(few(numbered.groupBy("family").agg(F.min("position").alias("first"))), "family")
    numbered = numbered.withColumn("pair", F.col("position") - F.col("first")).drop("position", "first")
    both = written(numbered.join(side("a"), ["family", "a"]).join(side("b"), ["family", "b"]), "pairs")

    def counted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for family, part in batch.groupby("family", sort=False):
                c = np.frombuffer(b"".join(part["codes"].tolist()), np.int8).reshape(len(part), -1)
                yield pd.DataFrame({"family": [family], "data": [state_counts(c, len(shared.value.states)).astype(float).tobytes()]})

    def tables(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """With the best lengths, which are made again where they are wanted: a table a family and batch is all that moves."""
        m = shared.value
        for batch in batches:
            for family, part in batch.groupby("family", sort=False):
                a, b = (np.frombuffer(b"".join(part[c].tolist()), np.int8).reshape(len(part), -1) for c in ("a_codes", "b_codes"))
                table = lengths_and_sums(a, b, m.logs, np.frombuffer(part["category"].iloc[0], np.int64))[1]
                yield pd.DataFrame({"family": [family], "data": [table.tobytes()]})

    def measured(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            for family, part in batch.groupby("family", sort=False):
                a, b = (np.frombuffer(b"".join(part[c].tolist()), np.int8).reshape(len(part), -1) for c in ("a_codes", "b_codes"))
                lengths = best_lengths(a, b, m.logs, np.frombuffer(part["category"].iloc[0], np.int64))
                yield pd.DataFrame({"family": family, "pair": part["pair"].to_numpy(), "length": lengths.astype(np.int32)})

    n_states, n_rates, weights, prior = len(model.states), len(model.rates), model.weights, model.prior
    category = _summed(own.mapInPandas(counted, f"family {kind}, data binary"), kind, lambda t: initial_categories(t.reshape(n_states, -1), weights))
    sites, row_bytes = category.select("family", (F.octet_length("category") / 8).cast("int").alias("n_sites")), 100 + (category.agg(F.max(F.octet_length("category"))).first()[0] or 0)
    given = lambda: both.select("family", "pair", "a_codes", "b_codes").join(few(category, row_bytes), "family")
    digest = lambda: category.agg(F.count("*"), F.sum(F.xxhash64("family", "category").cast("decimal(38,0)"))).first()
    before = digest()
    for _ in range(model.rounds):  # until rates stay, and lengths with them
        category = _summed(given().mapInPandas(tables, f"family {kind}, data binary"), kind, lambda t: best_rates(t.reshape(-1, n_rates), prior))
        now = digest()
        if now == before:
            break
        before = now
    lengths = written(given().mapInPandas(measured, f"family {kind}, pair long, length int"), "lengths")
    grid_points, rate_values = F.array(*[F.lit(float(p)) for p in model.points]), model.rates

    @F.pandas_udf("array<double>")
    def rate_arrays(data: pd.Series) -> pd.Series:
        return pd.Series([rate_values[np.frombuffer(x, np.int64)] for x in data])

    # a family of one sequence has no pairs that tell of rates
    rates = sites.join(few(category, row_bytes).withColumn("r", rate_arrays("category")), "family", "left")
    rates = rates.select("family", F.coalesce("r", F.array_repeat(F.lit(1.0), F.col("n_sites"))).alias("r"))
    size = F.greatest(F.size("r"), F.lit(1))
    rates = rates.withColumn("mean", F.when(F.size("r") == 0, 1.0).otherwise(F.aggregate("r", F.lit(0.0), lambda x, y: x + y) / size))
    rates = written(rates, "rates")
    half = F.element_at(grid_points, F.col("length") + 1) * F.col("mean") / 2
    hung = lengths.join(both.select("family", "pair", "a", "b"), ["family", "pair"]).join(few(rates.select("family", "mean")), "family")
    inner = F.concat(F.lit("internal-"), F.col("pair").cast("string"))
    ends = hung.select("family", inner.alias("parent"), F.posexplode(F.array("a", "b")).alias("child_ord", "k"), half.alias("length"))
    names = rows.select("family", "k", "seq_name")
    leaves = ends.join(names, ["family", "k"]).select("family", "parent", F.col("seq_name").alias("child"), "child_ord", "length")
    tops = hung.select("family", F.lit("root").alias("parent"), inner.alias("child"), F.col("pair").cast("int").alias("child_ord"), F.lit(1.0).alias("length"))
    last = both.groupBy("family").agg(F.count("*").cast("int").alias("child_ord"))
    alone = odd.join(names, ["family", "k"]).join(last, "family", "left").select("family", F.lit("root").alias("parent"), F.col("seq_name").alias("child"), F.coalesce("child_ord", F.lit(0)).alias("child_ord"), F.lit(1.0).alias("length"))
    edges = tops.unionByName(leaves).unionByName(alone)
    return edges, rates.select("family", F.transform("r", lambda r: r / F.col("mean")).alias("rates"))
