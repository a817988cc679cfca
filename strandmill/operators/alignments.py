"""Operators on alignments (family, seq_name, seq) and their columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.grid import initial_rate_weights
from strandmill.functions.ranks import values_at, with_before

GAPS = "._-"


def residues(msa: DataFrame) -> DataFrame:
    """(family, seq_name, site, state)."""
    return msa.select("family", "seq_name", F.posexplode(F.split("seq", "")).alias("site", "state"))


def family_sizes(msa: DataFrame) -> DataFrame:
    """(family, n_sequences, n_sites)."""
    return msa.groupBy("family").agg(F.count("*").alias("n_sequences"), F.max(F.length("seq")).cast("long").alias("n_sites"))


def residue_counts(msa: DataFrame) -> DataFrame:
    """(family, n_residues): characters that are no gaps."""
    return msa.groupBy("family").agg(F.sum(F.length(F.translate("seq", GAPS, ""))).alias("n_residues"))


def dataset_stats(msa: DataFrame) -> DataFrame:
    """One row: families, sequences, sites and residues."""
    per = msa.groupBy("family").agg(F.count("*").alias("s"), F.max(F.length("seq")).alias("w"), F.sum(F.length(F.translate("seq", GAPS, ""))).alias("r"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(F.count("*").alias("n_families"), total("s").alias("n_sequences"), total("w").alias("n_sites"), total("r").alias("n_residues"))


def within_cutoffs(msa: DataFrame, least: int, most: int) -> DataFrame:
    """family_sizes() of families with least to most sequences."""
    return family_sizes(msa).where(F.col("n_sequences").between(least, most))


def without_prefix(msa: DataFrame, prefix: str = "internal-") -> DataFrame:
    return msa.where(~F.col("seq_name").cast("string").startswith(prefix))


def encoded(msa: DataFrame, states: list[str]) -> DataFrame:
    """(family, seq_name, codes): positions of the states in the alphabet, -1 for all else."""
    return msa.select("family", "seq_name", F.transform(F.split("seq", ""), lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, states)), c), F.lit(0)).cast("int") - 1).alias("codes"))


def with_missing(msa: DataFrame, states: list[str], missing: str = "-") -> DataFrame:
    """Sequences with a missing mark for all that is not in the alphabet."""
    return msa.withColumn("seq", F.regexp_replace("seq", f"[^{re.escape(''.join(states))}]", missing))


def site_subset(msa: DataFrame, subset: DataFrame) -> DataFrame:
    """(family, seq_name, seq) of the sites in subset (family, k, site), in order of k."""
    sites = subset.groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "site"))), lambda s: s["site"]).alias("sites"))
    picked = F.transform("sites", lambda s: F.col("seq").substr(s + 1, F.lit(1)))
    return msa.join(sites, "family").select("family", "seq_name", F.array_join(picked, "").alias("seq"))


def site_subset_rates(rates: DataFrame, subset: DataFrame) -> DataFrame:
    """(family, rates) of the sites in subset (family, k, site), in order of k; rates is an array of site rates."""
    sites = subset.groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "site"))), lambda s: s["site"]).alias("sites"))
    return rates.join(sites, "family").select("family", F.transform("sites", lambda s: F.get("rates", s)).alias("rates"))


def column_histogram(msa: DataFrame, states: list[str]) -> DataFrame:
    """(family, site, state, n)."""
    return residues(msa).where(F.col("state").isin(states)).groupBy("family", "site", "state").agg(F.count("*").alias("n"))


def column_states(msa: DataFrame, states: list[str]) -> DataFrame:
    """(family, site, n_states)."""
    return column_histogram(msa, states).groupBy("family", "site").agg(F.count("*").alias("n_states"))


def site_variability(msa: DataFrame, states: list[str]) -> DataFrame:
    """(family, site, variability): the sum over states of n * (all others), 0 for a column of missing states."""
    h = column_histogram(msa, states).withColumn("total", F.sum("n").over(Window.partitionBy("family", "site")))
    seen = h.groupBy("family", "site").agg(F.sum((F.col("total") - F.col("n")) * F.col("n")).alias("variability"))
    every = msa.groupBy("family").agg(F.max(F.length("seq")).alias("w")).where("w > 0").select("family", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("site"))
    return every.join(seen, ["family", "site"], "left").select("family", "site", F.coalesce("variability", F.lit(0).cast("long")).alias("variability"))


def initial_rate_categories(variability: DataFrame, rates: list[float]) -> DataFrame:
    """(family, site, category): sites in order of variability dealt to ascending rates, as many to each as its
    share of the prior says; a site moves one category up at most past the one before it."""
    order = F.row_number().over(Window.partitionBy("family").orderBy("variability", "site")) - 1
    n = F.count("*").over(Window.partitionBy("family"))
    placed = variability.withColumns({"rank": order, "n": n})
    cuts = [F.floor(F.lit(w) * F.col("n") + 0.5) for w in initial_rate_weights(rates)]
    # the category goes up by one at the first rank, past the one where it last did, that reaches the category's own share
    category, reached = F.lit(0), None
    for cut in cuts[: len(rates) - 1]:
        reached = F.greatest(cut, F.lit(0)) if reached is None else F.greatest(cut, reached + 1)
        category = category + (F.col("rank") >= reached).cast("int")
    return placed.select("family", "site", category.alias("category"))


def extended_rates(rates: DataFrame, n_sites: int) -> DataFrame:
    """(family, site, rate) for n_sites sites: a family's rates, by site from 0, over and over; longer ones are cut."""
    sizes = rates.groupBy("family").agg(F.count("*").cast("int").alias("n"))
    places = F.sequence(F.col("site"), F.lit(n_sites - 1), F.col("n"))
    own = rates.join(sizes, "family").where(F.col("site") < n_sites)
    return own.select("family", F.explode(places).alias("site"), "rate")


def subsample(msa: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most `most` sequences of each family, the first by name always among them, the rest in order of a hash."""
    first = Window.partitionBy("family").orderBy("seq_name")
    lucky = F.md5(F.concat_ws("|", F.lit(seed), F.col("family"), F.col("seq_name").cast("string")))
    placed = msa.withColumn("rn", F.row_number().over(first))
    order = Window.partitionBy("family").orderBy(F.when(F.col("rn") == 1, 0).otherwise(1), lucky, "seq_name")
    return placed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("family", "seq_name", "seq")


def sample_families(msa: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The n families that a seeded hash puts first."""
    return msa.select("family").distinct().orderBy(F.md5(F.concat_ws("|", F.lit(seed), "family")), "family").limit(n)


def _distance(a: str, b: str, states: list[str]):
    """Differing and joint counts of two sequences, over sites where both have a state."""
    both = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.isin(states) & y.isin(states), (x != y).cast("int"))), lambda d: d.isNotNull())
    return F.aggregate(both, F.lit(0), lambda s, d: s + d), F.size(both)


#: Sequences of a family that one task compares with all of it.
PAIRED = 1024


def _packed(seq: str, states: list[str], width: int) -> list[Column]:
    """Per 64 sites: a number with a bit for each site with a state, and the bits of the states' places in the alphabet."""
    planes = max(1, math.ceil(math.log2(len(states))))
    other = next(c for c in "-._*" if c not in states)
    known = F.regexp_replace(seq, f"[^{re.escape(''.join(states))}]", other)
    kinds = ["1" * len(states)] + ["".join(str(k >> p & 1) for k in range(len(states))) for p in range(planes)]
    out = []
    for start in range(0, width, 64):
        part = F.substring(known, start + 1, 64)
        out += [F.conv(F.rpad(F.translate(part, "".join(states) + other, kind + "0"), 64, "0"), 2, -10).cast("long") for kind in kinds]
    return out


def hamming_pairs(msa: DataFrame, states: list[str]) -> DataFrame:
    """(family, x, y, distance) of all pairs x < y of each family: the share of differing sites, 0 without joint ones.

    The full distance matrix is the result asked for; fast_cherries() needs only a few rows of it.  Sequences are packed
    into bits once and pairs compared by those; a large family is dealt into parts of PAIRED sequences, and a task compares
    two of them.  A null sequence has no state at any site.
    """
    msa = msa.withColumn("seq", F.coalesce("seq", F.lit("")))
    width = msa.agg(F.max(F.length("seq"))).first()[0] or 0
    bits = _packed("seq", states, width)
    per = max(1, math.ceil(math.log2(len(states)))) + 1
    packed = msa.select("family", "seq_name", *[b.alias(f"b{k}") for k, b in enumerate(bits)])
    parts = msa.groupBy("family").agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("parts"))
    own = packed.join(parts, "family").withColumn("mine", F.pmod(F.xxhash64("seq_name"), "parts").cast("int"))
    # part lo meets each part hi >= lo once
    side = lambda c, other, lo, hi: own.withColumn("o", F.explode(other)).select("family", lo.alias("lo"), hi.alias("hi"), F.col("seq_name").alias(c), *[F.col(f"b{k}").alias(f"{c}{k}") for k in range(len(bits))])
    a = side("x", F.sequence("mine", F.col("parts") - 1), F.col("mine"), F.col("o"))
    b = side("y", F.sequence(F.lit(0), "mine"), F.col("o"), F.col("mine"))
    differ, joint = F.lit(0), F.lit(0)
    for at in range(0, len(bits), per):
        both = F.col(f"x{at}").bitwiseAND(F.col(f"y{at}"))
        other = F.lit(0).cast("long")
        for k in range(at + 1, at + per):
            other = other.bitwiseOR(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}")))
        differ, joint = differ + F.bit_count(both.bitwiseAND(other)), joint + F.bit_count(both)
    met = a.join(b, ["family", "lo", "hi"]).where("x <> y and (lo < hi or x < y)")
    return met.select("family", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.when(joint == 0, 0.0).otherwise(differ / joint).alias("distance"))


def farthest_sequence(msa: DataFrame, states: list[str]) -> DataFrame:
    """(family, x, y, distance): the sequence farthest from the family's first, the first of equals."""
    first = msa.groupBy("family").agg(F.min_by("seq", "seq_name").alias("x_seq"), F.min("seq_name").alias("x"))
    differ, joint = _distance("x_seq", "seq", states)
    far = msa.join(first, "family").withColumn("distance", F.when(joint == 0, 0.0).otherwise(differ / joint))
    best = F.max_by(F.struct(F.col("seq_name").alias("y"), "distance"), F.struct("distance", (-F.col("seq_name")).alias("o")))
    return far.groupBy("family", "x").agg(best.alias("b")).select("family", "x", "b.y", "b.distance")


def site_pair_cooccurrence(msa: DataFrame, first: str, second: str, least_share: float = 1 / 8, least_swapped: float = 0.2) -> DataFrame:
    """(family, i, j, first_second, second_first, first_first, second_second, total): pairs of sites i < j that trade two
    states.

    total counts the sequences that have one of the two states at either site, the four shares are of those.  Reported
    are pairs whose total is at least a share of the family's sequences and both of whose mixed shares exceed
    least_swapped.  Pairs are made from a sequence's own row and counted before they move.
    """
    sites = F.filter(F.transform(F.split("seq", ""), lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda s: s["c"].isin(first, second))
    rows = msa.select("family", sites.alias("all")).select("family", "all", F.explode("all").alias("p"))
    rows = rows.select("family", "p", F.explode(F.filter("all", lambda s: s["i"] > F.col("p.i"))).alias("q"))
    share = lambda a, b: F.avg(((F.col("p.c") == a) & (F.col("q.c") == b)).cast("double"))
    names = {"first_second": (first, second), "second_first": (second, first), "first_first": (first, first), "second_second": (second, second)}
    pairs = rows.groupBy("family", F.col("p.i").alias("i"), F.col("q.i").alias("j")).agg(*[share(*ab).alias(n) for n, ab in names.items()], F.count("*").alias("total"))
    sizes = msa.groupBy("family").agg(F.count("*").alias("sequences"))
    found = pairs.where((F.col("first_second") > least_swapped) & (F.col("second_first") > least_swapped)).join(sizes, "family")
    return found.where(F.col("total") >= F.col("sequences") * least_share).select("family", "i", "j", *names, "total")


def quantile_bins(values: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n, mean, q25, q75): rows in equally frequent bins by value, by exact quantiles.

    Different values are counted and ordered by ranges; boundaries and quartiles are looked up by their places.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ordered = with_before(counted, column, "n").persist()
    rows = ordered.agg(F.sum("n")).first()[0] or 0
    cuts = values_at(ordered, column, "n", [(rows - 1) * k / bins for k in range(1, bins)] if rows else [])
    number = F.col(column).cast("double")
    placed = ordered.withColumn("bin", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < number)) if cuts else F.lit(0))
    per = placed.groupBy("bin").agg(F.sum("n").alias("n"), F.min("before").alias("first"), F.sum(number * F.col("n")).alias("total")).orderBy("bin").collect()  # a row a bin
    places = [r["first"] + (r["n"] - 1) * q for r in per for q in (0.25, 0.75)]
    quartiles = values_at(ordered, column, "n", places)
    ordered.unpersist()
    out = [(r["bin"], r["n"], r["total"] / r["n"], quartiles[2 * k], quartiles[2 * k + 1]) for k, r in enumerate(per)]
    return values.sparkSession.createDataFrame(out, "bin int, n long, mean double, q25 double, q75 double")
