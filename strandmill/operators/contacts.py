"""Contacts between sites: (family, i, j) or (i, j) with i < j."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.storage import shared_folder, written
from strandmill.operators.trees import families_by_size


def nontrivial(contacts: DataFrame, distance: int) -> DataFrame:
    """Contacts i < j at least `distance` sites apart."""
    return contacts.where((F.abs(F.col("i") - F.col("j")) >= distance) & (F.col("i") < F.col("j")))


def contacting_sites(contacts: DataFrame, distance: int) -> DataFrame:
    """([family,] k, site): the different sites of nontrivial contacts, numbered in order."""
    near = nontrivial(contacts, distance)
    key = [c for c in ("family",) if c in near.columns]
    sites = near.select(*key, F.col("i").alias("site")).union(near.select(*key, F.col("j").alias("site"))).distinct()
    return sites.select(*key, (F.row_number().over(Window.partitionBy(*key).orderBy("site")) - 1).alias("k"), "site")


def rates_by_contacts(rates: DataFrame, contacts: DataFrame, distance: int) -> DataFrame:
    """(n_contacts, n, mean, median, q25, q75): site rates (family, site, rate) by the site's number of nontrivial contacts."""
    near = nontrivial(contacts, distance)
    ends = near.select(F.col("i").alias("site")).union(near.select(F.col("j").alias("site"))).groupBy("site").agg(F.count("*").alias("c"))
    joined = rates.join(F.broadcast(ends), "site", "left").withColumn("n_contacts", F.coalesce("c", F.lit(0)).cast("long"))
    q = lambda p: F.percentile("rate", F.lit(p))
    return joined.groupBy("n_contacts").agg(F.count("*").alias("n"), F.avg("rate").alias("mean"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"))


#: Contacts of a family that are matched as one group.
WHOLE_CONTACTS = 1 << 18


def maximal_matching(contacts: DataFrame, distance: int, whole: int = WHOLE_CONTACTS) -> DataFrame:
    """(family, i, j): contacts taken greedily in order of (i, j) so that no site is in two.

    A family of up to `whole` contacts is a group.  Larger ones are matched in rounds, all at once: of what is still open,
    about the first `whole` contacts are matched as the order has it, then every contact that is the first one left at
    both of its sites is taken, as no earlier one can keep it out; contacts at sites that are taken are dropped.  That gives what one
    scan in order gives, in no more rounds than contacts / whole, and fewer where contacts do not wait for each other.
    """
    family, site = (contacts.schema[c].dataType.simpleString() for c in ("family", "i"))
    kind = f"family {family}, i {site}, j {site}"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        used, kept = set(), []
        for f, i, j in group.sort_values(["i", "j"])[["family", "i", "j"]].itertuples(index=False):
            if i not in used and j not in used:
                used |= {i, j}
                kept.append((f, i, j))
        return pd.DataFrame(kept, columns=["family", "i", "j"])

    near = nontrivial(contacts, distance).select("family", "i", "j")
    open_, large = families_by_size(near, whole)
    found = open_.groupBy("family").applyInPandas(run, kind)
    while large is not None:
        open_ = written(large.distinct(), "contacts")
        # the last site of the first `whole` contacts, to a hundredth of the family's
        hundredths = F.percentile_approx("i", F.array(*[F.lit(k / 100) for k in range(1, 101)]), F.lit(1000))
        place = F.greatest(F.least(F.floor(F.lit(100 * whole) / F.col("n")), F.lit(100)), F.lit(1)).cast("int")
        cut = open_.groupBy("family").agg(hundredths.alias("cuts"), F.count("*").alias("n")).select("family", F.element_at("cuts", place).alias("cut"))
        split = open_.join(cut, "family").withColumn("early", F.col("i") <= F.col("cut"))
        taken = written(split.where("early").select("family", "i", "j").groupBy("family").applyInPandas(run, kind), "matched")
        left = written(_without(split.where("not early").select("family", "i", "j"), taken), "contacts")
        ends = _ends(left).groupBy("family", "site").agg(F.min(F.struct("i", "j")).alias("least"))
        at = lambda c: ends.select("family", F.col("site").alias(c), F.col("least").alias(f"least_{c}"))  # noqa: B023, E731
        own = F.struct("i", "j")
        free = left.join(at("i"), ["family", "i"]).join(at("j"), ["family", "j"]).where((F.col("least_i") == own) & (F.col("least_j") == own)).select("family", "i", "j")
        free = written(free, "matched")
        open_, large = families_by_size(written(_without(left, free), "contacts"), whole)
        found = found.unionByName(taken).unionByName(free).unionByName(open_.groupBy("family").applyInPandas(run, kind))
    return found


#: Sites of a family that are matched as one group.
WHOLE_SITES = 1 << 16
#: Sites, about, by which a larger family goes on in a round: a slab of its order.
SLAB_SITES = 1 << 16
#: Width of a cell in cutoffs; what is over 1 is more than rounding takes.
CELL = 1.01


def matching_of_points(atoms: DataFrame, cutoff: float, distance: int, whole: int = WHOLE_SITES) -> DataFrame:
    """maximal_matching() of distance_contacts() of residues (family, site, x, y, z), without making the contacts, which
    are as many as pairs of points in dense families.

    In order of (i, j), a site's first contact is that with its smallest partner, whether that comes before or after it.
    Order by (j, i) says the same of every site, so both take the same contacts: a site takes the smallest one before it
    that is in reach and still free, or is free itself.  Free sites are in reach of each other only if they are less than
    `distance` apart, so a cell holds few of them however dense its family is, and a site is compared with those of 27
    cells.

    A family of up to `whole` sites is one group.  Larger ones go on by slabs of their order, all families in a round: a
    group is about SLAB_SITES sites and those free before them in cells around theirs.  What a slab takes stays, so
    rounds are as many as slabs of the largest family.
    """
    points = atoms.select("family", "site", *[F.col(c).cast("double").alias(c) for c in "xyz"]).dropna()
    points = points.where(F.greatest(*[F.abs(c) for c in "xyz"]) < float("inf"))  # nothing is near infinity
    family, site = (points.schema[c].dataType.simpleString() for c in ("family", "site"))
    kind = f"family {family}, i {site}, j {site}"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("site")
        i, j, _ = _taken(group["site"].to_numpy(), group[["x", "y", "z"]].to_numpy(), cutoff, distance)
        return pd.DataFrame({"family": group["family"].iloc[0], "i": i, "j": j})

    def turn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("site")
        i, j, free = _taken(group["site"].to_numpy(), group[["x", "y", "z"]].to_numpy(), cutoff, distance, group["known"].to_numpy(bool))
        taken = pd.DataFrame({"family": group["family"].iloc[0], "i": i, "j": j, "x": 0.0, "y": 0.0, "z": 0.0})
        left = group[free].rename(columns={"site": "i"}).assign(j=group["site"])
        return pd.concat([taken, left[taken.columns]]) if len(i) else left[taken.columns]

    open_, large = families_by_size(points, whole)
    found = open_.groupBy("family").applyInPandas(run, kind)
    if large is None:
        return found

    sites, slabs = _slabs(large)
    spark = atoms.sparkSession
    kind, folder, free = f"{kind}, x double, y double, z double", f"{shared_folder(spark)}/matched-{uuid.uuid4().hex}", None
    for k in range(slabs):
        part = sites.where(F.col("slab") == k).drop("slab").withColumn("known", F.lit(False))
        if free is None:
            now = part.groupBy("family").applyInPandas(turn, kind)
        else:
            around = _cells(part, cutoff).select("family", "cx", "cy", "cz").distinct()
            for c in ("cx", "cy", "cz"):
                around = around.withColumn("d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(c, F.col(c) + F.col("d")).drop("d")
            near = _cells(free, cutoff).join(around.distinct(), ["family", "cx", "cy", "cz"], "left_semi").select("family", "site").distinct()
            seen = free.join(near.withColumn("near", F.lit(True)), ["family", "site"], "left")  # a site with all of its points
            now = part.unionByName(seen.where("near").withColumn("known", F.lit(True)).select(part.columns)).groupBy("family").applyInPandas(turn, kind)
            now = now.unionByName(seen.where("near is null").select("family", F.col("site").alias("i"), F.col("site").alias("j"), "x", "y", "z"))
        now.write.parquet(f"{folder}/slab={k}")
        # a site that is free is a row by itself
        free = spark.read.schema(kind).parquet(f"{folder}/slab={k}").where("i = j").select("family", F.col("i").alias("site"), "x", "y", "z")
    return found.unionByName(spark.read.schema(kind).parquet(folder).where("i < j").select("family", "i", "j"))


def _slabs(points: DataFrame) -> tuple[DataFrame, int]:
    """Adds slab: sites of each family in order, in as many parts as the largest one asks for; and their number."""
    slabs = -(-points.groupBy("family").count().agg(F.max("count")).first()[0] // SLAB_SITES)
    if slabs == 1:
        return points.withColumn("slab", F.lit(0)), 1
    cuts = F.percentile_approx("site", [k / slabs for k in range(1, slabs)], max(10_000, 10 * slabs))
    placed = points.join(points.groupBy("family").agg(cuts.alias("cuts")), "family").withColumn("slab", F.size(F.filter("cuts", lambda c: c < F.col("site"))))
    return written(placed.drop("cuts").repartition("family", "slab"), "slabs", by="slab"), slabs


def _cells(points: DataFrame, cutoff: float) -> DataFrame:
    """Adds cx, cy, cz: points closer than cutoff are in the same or in neighbouring cells."""
    return points.withColumns({f"c{k}": F.rint(F.col(k) / (CELL * cutoff)) for k in "xyz"})


def _taken(site: np.ndarray, points: np.ndarray, cutoff: float, distance: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, free): contacts taken, and which rows are of sites that are left; site is in ascending order, and one at
    several points is in contact by any of them.  Rows of sites that are known to take none before them are marked."""
    sites, starts, own = np.unique(site, return_index=True, return_inverse=True)
    starts = [*starts.tolist(), len(site)]
    reach = np.searchsorted(sites, sites - max(distance, 1), side="right")
    reach = (reach if known is None else np.where(known[starts[:-1]], 0, reach)).tolist()
    # whole numbers of any size, so that far points have their own cells
    at = [[int(v) for v in axis] for axis in np.clip(np.floor(points / (CELL * cutoff)), -1e300, 1e300).T.tolist()]
    _, rows, layers = (max(axis) - min(axis) + 3 for axis in at)
    cell = [(x * rows + y) * layers + z for x, y, z in zip(*at, strict=True)]
    steps = [(x * rows + y) * layers + z for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    where, waiting = points.tolist(), {}
    i, j, free = [], [], np.ones(len(sites), bool)
    for n in range(len(sites)):
        least = reach[n]
        for k in range(starts[n], starts[n + 1]) if least else ():
            x, y, z = where[k]
            for step in steps:
                for m, a, b, c in waiting.get(cell[k] + step, ()):
                    if m < least and math.sqrt((a - x) * (a - x) + (b - y) * (b - y) + (c - z) * (c - z)) < cutoff:
                        least = m
        if least < reach[n]:
            free[least] = free[n] = False
            i.append(least)
            j.append(n)
            for k in range(starts[least], starts[least + 1]):
                waiting[cell[k]] = [w for w in waiting[cell[k]] if w[0] != least]
        else:
            for k in range(starts[n], starts[n + 1]):
                waiting.setdefault(cell[k], []).append((n, *where[k]))
    return sites[np.array(i, int)], sites[np.array(j, int)], free[own]


def _ends(contacts: DataFrame) -> DataFrame:
    """(family, site, i, j): each contact at both of its sites."""
    return contacts.select("family", F.explode(F.array("i", "j")).alias("site"), "i", "j")


def _without(contacts: DataFrame, taken: DataFrame) -> DataFrame:
    """Contacts none of whose sites is taken."""
    used = _ends(taken).select("family", "site")
    for c in ("i", "j"):
        contacts = contacts.join(used.withColumnRenamed("site", c), ["family", c], "left_anti")
    return contacts.select("family", "i", "j")


def distance_contacts(atoms: DataFrame, cutoff: float) -> DataFrame:
    """(family, i, j): residues i < j whose coordinates (family, site, x, y, z) are closer than cutoff.

    Points meet in cells of the cutoff's width, a point in its own and its neighbours', so no pair far apart is made.
    """
    cell = lambda c: F.floor(F.col(c) / cutoff)
    at = atoms.withColumns({"cx": cell("x"), "cy": cell("y"), "cz": cell("z")})
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = at
    for c in ("cx", "cy", "cz"):
        around = around.withColumn("d", F.explode(steps)).withColumn(c, F.col(c) + F.col("d")).drop("d")
    a = at.select("family", "cx", "cy", "cz", F.col("site").alias("i"), F.struct("x", "y", "z").alias("p"))
    b = around.select("family", "cx", "cy", "cz", F.col("site").alias("j"), F.struct("x", "y", "z").alias("q"))
    square = sum((F.col(f"p.{c}") - F.col(f"q.{c}")) ** 2 for c in "xyz")
    return a.join(b, ["family", "cx", "cy", "cz"]).where((F.col("i") < F.col("j")) & (F.sqrt(square) < cutoff)).select("family", "i", "j")


#: Length and angles by which a side chain's first atom stands off its backbone: fixed values of proteins.
BOND, ANGLE, TURN = 1.522, 1.927, -2.143


def side_atoms(backbone: DataFrame) -> DataFrame:
    """(family, site, x, y, z): the first side-chain atom of residues (family, site, N, CA, C), made up from the backbone,
    so that glycine has one too."""
    point = lambda c: [F.col(f"{c}.{k}") for k in "xyz"]
    n, a, c = point("N"), point("CA"), point("C")
    minus = lambda p, q: [x - y for x, y in zip(p, q, strict=True)]
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]

    def unit(p):
        size = F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])
        return [x / size for x in p]

    # axes: along N to CA, and two across it, of which one lies in the plane with C
    along = unit(minus(n, a))
    up = unit(cross(minus(n, c), along))
    side = cross(up, along)
    parts = BOND * math.cos(ANGLE), BOND * math.sin(ANGLE) * math.cos(TURN), -BOND * math.sin(ANGLE) * math.sin(TURN)
    made = [o + parts[0] * x + parts[1] * y + parts[2] * z for o, x, y, z in zip(a, along, side, up, strict=True)]
    return backbone.select("family", "site", *[m.alias(k) for m, k in zip(made, "xyz", strict=True)])


def backbone_contacts(backbone: DataFrame, cutoff: float = 8.0) -> DataFrame:
    """(family, i, j): all residues, themselves included and in both orders, whose side_atoms() are closer than cutoff."""
    near = distance_contacts(side_atoms(backbone), cutoff)
    own = backbone.select("family", F.col("site").alias("i"), F.col("site").alias("j"))
    return near.unionByName(near.select("family", F.col("j").alias("i"), F.col("i").alias("j"))).unionByName(own)


def trivial_contacts(sites: DataFrame) -> DataFrame:
    """(family, i, j): every site of (family, n_sites) touches itself and nothing else."""
    return sites.select("family", F.explode(F.sequence(F.lit(0), F.col("n_sites").cast("int") - 1)).alias("i")).withColumn("j", F.col("i"))
