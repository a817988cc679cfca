"""Readers and writers of the field's text formats, one file a family, as DataFrames.

Readers load whole files (`<folder>/<family>.txt`), a row each, and take them apart with SQL functions; counts in
headers are checked and a file that breaks its format raises an error.  Writers put one file a family back: rows of
a family become one text, written under a folder of its own so that partitions never share a file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str) -> DataFrame:
    """(family, text): whole files, the family being a file's name without folder and ending, or that of write_files()."""
    at = F.input_file_name()
    name = F.regexp_extract(at, r"([^/]+?)(?:\.[^./]*)?$", 1)
    # the folder's name is escaped by its writer, and again in the file's address
    folder = F.regexp_extract(at, r"/family=([^/]+)/[^/]+$", 1)
    for _ in range(2):
        folder = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    family = F.when(folder != "", folder).otherwise(name)
    return spark.read.text(path, wholetext=True).select(family.alias("family"), F.regexp_replace("value", r"\r\n", "\n").alias("text"))


def _lines(text: Column | str) -> Column:
    return F.split(F.regexp_replace(text, r"\n+$", ""), "\n")


def _check(condition: Column, message: str, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.concat(F.lit(f"{message}: "), F.col("family"))))


def _counted(name: str, cast: str) -> Column:
    """The numbers on the second line, whose count is on the first."""
    line = _lines("text")
    values = F.when(F.size(line) < 2, F.array().cast("array<string>")).otherwise(F.filter(F.split(F.trim(line[1]), r"\s+"), lambda v: v != ""))
    n = F.regexp_extract(line[0], r"^\s*(\d+)", 1).cast("int")
    return F.transform(_check(F.size(values) == n, f"wrong number of {name}", values), lambda v: v.cast(cast))


def read_msa(spark: SparkSession, path: str) -> DataFrame:
    """(family, seq_name, seq) of two-line records."""
    line = _lines("text")
    ok = (F.size(line) % 2 == 0) & F.forall(line, lambda v: v.isNotNull()) & F.forall(F.filter(line, lambda v, k: k % 2 == 0), lambda v: v.startswith(">"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size(line) / 2).cast("int") - 1), lambda k: F.struct(F.substring(F.get(line, 2 * k), 2, 1 << 30).alias("seq_name"), F.get(line, 2 * k + 1).alias("seq")))
    return files(spark, path).select("family", F.explode(_check(ok, "not two-line FASTA", pairs)).alias("r")).select("family", "r.*")


def msa_text(msa: DataFrame) -> DataFrame:
    """(family, text): records in order of name."""
    record = F.struct("seq_name", F.concat(F.lit(">"), F.col("seq_name").cast("string"), F.lit("\n"), "seq", F.lit("\n")).alias("t"))
    return msa.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(record)), lambda r: r["t"]), "").alias("text"))


def write_files(texts: DataFrame, path: str) -> None:
    """(family, text) as `<path>/family=<family>/part-*.txt`, for files(); a text ends in one line break in its file."""
    value = F.regexp_replace("text", r"\n$", "").alias("value")
    texts.select(value, F.col("family").cast("string").alias("family")).write.partitionBy("family").mode("overwrite").text(path)


def read_a3m(spark: SparkSession, path: str, keep_insertions: bool = False) -> DataFrame:
    """(family, seq_name, seq): lower-case insertions dropped, or kept as upper case with gaps dropped."""
    rows = read_msa(spark, path)
    return rows.withColumn("seq", F.upper(F.replace("seq", F.lit("-"), F.lit(""))) if keep_insertions else F.regexp_replace("seq", "[a-z]", ""))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(family, parent, child, child_ord, length): `N nodes`, N names, `M edges`, M lines `u v length`."""
    line = _lines("text")
    n = F.regexp_extract(line[0], r"^(\d+) nodes", 1).cast("int")
    m = F.regexp_extract(F.get(line, n + 1), r"^(\d+) edges", 1).cast("int")
    edges = F.filter(line, lambda v, k: k >= n + 2)
    own = files(spark, path).withColumns({"names": F.filter(line, lambda v, k: (k >= 1) & (k <= n)), "edges": _check(F.size(edges) == m, "wrong number of edges", edges)})
    row = own.select("family", "names", F.posexplode("edges").alias("k", "e")).withColumn("e", F.split("e", r"\s+"))
    known = F.array_contains("names", F.col("e")[0]) & F.array_contains("names", F.col("e")[1])
    row = row.select("family", "k", _check(known, "an edge between unknown nodes", F.col("e")).alias("e"))
    order = F.row_number().over(Window.partitionBy("family", "parent").orderBy("k")) - 1
    row = row.select("family", F.col("e")[0].alias("parent"), F.col("e")[1].alias("child"), F.col("e")[2].cast("double").alias("length"), "k")
    return row.select("family", "parent", "child", order.alias("child_ord"), "length")


def tree_text(edges: DataFrame) -> DataFrame:
    """(family, text) in the format of read_tree()."""
    line = F.struct("parent", "child_ord", F.concat_ws(" ", F.col("parent").cast("string"), F.col("child").cast("string"), F.col("length").cast("string")).alias("t"))
    by = edges.groupBy("family").agg(F.array_sort(F.collect_list(line)).alias("e"), F.array_sort(F.array_distinct(F.concat(F.collect_list(F.col("parent").cast("string")), F.collect_list(F.col("child").cast("string"))))).alias("n"))
    parts = F.concat(F.array(F.concat(F.size("n").cast("string"), F.lit(" nodes"))), "n", F.array(F.concat(F.size("e").cast("string"), F.lit(" edges"))), F.transform("e", lambda e: e["t"]))
    return by.select("family", F.concat(F.array_join(parts, "\n"), F.lit("\n")).alias("text"))


def read_site_rates(spark: SparkSession, path: str) -> DataFrame:
    """(family, site, rate)."""
    return files(spark, path).select("family", F.posexplode(_counted("sites", "double")).alias("site", "rate"))


def read_sites_subset(spark: SparkSession, path: str) -> DataFrame:
    """(family, k, site): may be empty."""
    return files(spark, path).select("family", F.posexplode(_counted("sites", "int")).alias("k", "site"))


def numbers_text(values: DataFrame, order: str, column: str, what: str = "sites") -> DataFrame:
    """(family, text) in the format of read_site_rates() and read_sites_subset()."""
    by = values.groupBy("family").agg(F.array_sort(F.collect_list(F.struct(order, F.col(column).cast("string").alias("t")))).alias("v"))
    return by.select("family", F.concat(F.size("v").cast("string"), F.lit(f" {what}\n"), F.array_join(F.transform("v", lambda v: v["t"]), " ")).alias("text"))


def read_contact_map(spark: SparkSession, path: str) -> DataFrame:
    """(family, i, j): the ones of a square of 0 and 1."""
    line = _lines("text")
    n = F.regexp_extract(line[0], r"^(\d+) sites", 1).cast("int")
    rows = F.filter(line, lambda v, k: k > 0)
    ok = (F.size(rows) == n) & F.forall(rows, lambda r: r.rlike("^[01]*$") & (F.length(r) == n))
    ones = files(spark, path).select("family", F.posexplode(_check(ok, "not a square contact map", rows)).alias("i", "row"))
    return ones.select("family", "i", F.posexplode(F.split("row", "")).alias("j", "c")).where("c = '1'").select("family", "i", "j")


def contact_map_text(contacts: DataFrame, sites: DataFrame) -> DataFrame:
    """(family, text) of contacts (family, i, j) and sizes (family, n_sites)."""
    near = contacts.groupBy("family").agg(F.collect_set(F.struct("i", "j")).alias("c"))
    span = F.sequence(F.lit(0), F.col("n_sites").cast("int") - 1)
    cell = lambda i, j: F.when(F.array_contains("c", F.struct(i.alias("i"), j.alias("j"))), "1").otherwise("0")
    square = F.transform(span, lambda i: F.array_join(F.transform(span, lambda j: cell(i, j)), ""))
    empty = F.array().cast("array<struct<i:int,j:int>>")
    both = sites.join(near, "family", "left").withColumn("c", F.coalesce("c", empty))
    return both.select("family", F.concat_ws("\n", F.concat(F.col("n_sites").cast("string"), F.lit(" sites")), F.array_join(square, "\n")).alias("text"))


def _table_rows(text: str) -> Iterator[tuple[str, str, float]]:
    lines = [x for x in text.split("\n") if x.strip()]
    columns = lines[0].split()
    for line in lines[1:]:
        name, *values = line.split()
        if len(values) != len(columns):
            raise ValueError(f"{len(values)} values under {len(columns)} columns")
        yield from ((name, c, float(v)) for c, v in zip(columns, values, strict=True))


def read_matrix(spark: SparkSession, path: str, column: str = "q") -> DataFrame:
    """(family, x, y, column) of labelled squares; a state may be called NA."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for family, text in batch.itertuples(index=False):
                out = pd.DataFrame(list(_table_rows(text)), columns=["x", "y", column])
                out.insert(0, "family", family)
                yield out

    return files(spark, path).mapInPandas(run, f"family string, x string, y string, {column} double")


def matrix_text(rates: DataFrame, column: str = "q") -> DataFrame:
    """(text), one row: a labelled square; it has states x states entries."""
    row = rates.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("y", F.col(column).cast("string").alias("v")))).alias("r"))
    all_rows = row.agg(F.array_sort(F.collect_list(F.struct("x", "r"))).alias("m"))
    head = F.concat(F.lit("\t"), F.array_join(F.transform(F.col("m")[0]["r"], lambda r: r["y"]), "\t"))
    body = F.transform("m", lambda m: F.concat(m["x"], F.lit("\t"), F.array_join(F.transform(m["r"], lambda r: r["v"]), "\t")))
    return all_rows.select(F.concat_ws("\n", head, F.array_join(body, "\n")).alias("text"))


def read_distribution(spark: SparkSession, path: str) -> DataFrame:
    """(family, state, prob): the probabilities must sum to 1."""
    line = F.filter(_lines("text"), lambda v, k: (k > 0) & (F.trim(v) != ""))
    values = F.transform(line, lambda v: F.struct(F.split(F.trim(v), r"\s+")[0].alias("state"), F.split(F.trim(v), r"\s+")[1].cast("double").alias("prob")))
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v["prob"])
    return files(spark, path).select("family", F.explode(_check(F.abs(total - 1) < 1e-6, "probabilities do not sum to 1", values)).alias("v")).select("family", "v.*")


def distribution_text(probabilities: DataFrame) -> DataFrame:
    """(text), one row, of (state, prob): a row for each state, under a heading."""
    rows = probabilities.agg(F.array_sort(F.collect_list(F.struct("state", F.col("prob").cast("string").alias("p")))).alias("r"))
    return rows.select(F.concat(F.lit("state\tprob\n"), F.array_join(F.transform("r", lambda r: F.concat(r["state"], F.lit("\t"), r["p"])), "\n"), F.lit("\n")).alias("text"))


def read_count_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(family, bucket, t, x, y, n): `B matrices`, `S states`, then for each bucket its time and a labelled square."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for family, text in batch.itertuples(index=False):
                lines = [x for x in text.split("\n") if x.strip()]
                n_matrices, n_states = int(lines[0].split()[0]), int(lines[1].split()[0])
                size = n_states + 2
                if len(lines) != 2 + n_matrices * size:
                    raise ValueError(f"{family}: not {n_matrices} matrices of {n_states} states")
                for b in range(n_matrices):
                    part = lines[2 + b * size : 2 + (b + 1) * size]
                    out = pd.DataFrame(list(_table_rows("\n".join(part[1:]))), columns=["x", "y", "n"])
                    out.insert(0, "t", float(part[0]))
                    out.insert(0, "bucket", b)
                    out.insert(0, "family", family)
                    yield out

    return files(spark, path).mapInPandas(run, "family string, bucket int, t double, x string, y string, n double")


def count_matrices_text(counts: DataFrame, states: list[str], points: list[float]) -> str:
    """The format of read_count_matrices(), of at most points x states x states counts."""
    own = {(r.bucket, r.x, r.y): r.n for r in counts.collect()}
    out = [f"{len(points)} matrices", f"{len(states)} states"]
    for b, t in enumerate(points):
        out += [str(t), "\t" + "\t".join(states)]
        out += [x + "\t" + "\t".join(str(own.get((b, x, y), 0.0)) for y in states) for x in states]
    return "\n".join(out) + "\n"


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    """(family, tid, x, y, t): `N transitions`, then `x y t` a line."""
    line = _lines("text")
    n = F.regexp_extract(line[0], r"^(\d+) transitions", 1).cast("int")
    rows = F.filter(line, lambda v, k: k > 0)
    out = files(spark, path).select("family", F.posexplode(_check(F.size(rows) == n, "wrong number of transitions", rows)).alias("tid", "r"))
    part = F.split("r", " ")
    return out.select("family", "tid", part[0].alias("x"), part[1].alias("y"), part[2].cast("double").alias("t"))


def _listed(rows: DataFrame, order: str, line: Column, head: str) -> DataFrame:
    """(family, text): the number of a family's rows and a line for each."""
    by = rows.groupBy("family").agg(F.array_sort(F.collect_list(F.struct(order, line.alias("t")))).alias("r"))
    return by.select("family", F.concat(F.size("r").cast("string"), F.lit(f" {head}\n"), F.array_join(F.transform("r", lambda r: r["t"]), "\n"), F.lit("\n")).alias("text"))


def transitions_text(transitions: DataFrame) -> DataFrame:
    """(family, text) in the format of read_transitions()."""
    return _listed(transitions, "tid", F.concat_ws(" ", "x", "y", F.col("t").cast("string")), "transitions")


def transition_likelihoods_text(values: DataFrame) -> DataFrame:
    """(family, text) of (family, tid, ll), or of lls, an array with a value for each site, in place of ll."""
    per_site = "lls" in values.columns
    line = F.concat_ws(" ", F.transform("lls", lambda v: v.cast("string"))) if per_site else F.col("ll").cast("string")
    return _listed(values, "tid", line, "transitions")


def read_transition_likelihoods(spark: SparkSession, path: str, per_site: bool = False) -> DataFrame:
    """(family, tid, ll): `N transitions`, then a value a line; per site (family, tid, lls), values parted by blanks."""
    line = _lines("text")
    n = F.regexp_extract(line[0], r"^(\d+) transitions$", 1).cast("int")
    rows = F.filter(line, lambda v, k: k > 0)
    out = files(spark, path).select("family", F.posexplode(_check(F.coalesce(F.size(rows) == n, F.lit(False)), "wrong number of transitions", rows)).alias("tid", "r"))
    if per_site:
        return out.select("family", "tid", F.transform(F.split(F.trim("r"), r"\s+"), lambda v: v.cast("double")).alias("lls"))
    return out.select("family", "tid", F.col("r").cast("double").alias("ll"))


def cherries_text(cherries: DataFrame) -> DataFrame:
    """(family, text) of (family, k, x, y, t) in the format of read_cherries()."""
    line = F.struct("k", F.concat_ws("\n", "x", "y", F.col("t").cast("string")).alias("t"))
    by = cherries.groupBy("family").agg(F.array_sort(F.collect_list(line)).alias("r"))
    return by.select("family", F.concat(F.array_join(F.transform("r", lambda r: r["t"]), "\n"), F.lit("\n")).alias("text"))


def log_likelihood_text(values: DataFrame) -> DataFrame:
    """(family, text) of (family, total, sites), sites being an array or null, in the format of read_log_likelihood()."""
    own = F.concat(F.lit("\n"), F.size("sites").cast("string"), F.lit(" sites\n"), F.array_join(F.transform("sites", lambda v: v.cast("string")), " "))
    return values.select("family", F.concat(F.col("total").cast("string"), F.when(F.col("sites").isNotNull(), own).otherwise(""), F.lit("\n")).alias("text"))


def read_cherries(spark: SparkSession, path: str) -> DataFrame:
    """(family, k, x, y, t): three lines a pair."""
    line = _lines("text")
    k = F.sequence(F.lit(0), (F.size(line) / 3).cast("int") - 1)
    rows = F.transform(k, lambda i: F.struct(i.alias("k"), F.get(line, 3 * i).alias("x"), F.get(line, 3 * i + 1).alias("y"), F.get(line, 3 * i + 2).cast("double").alias("t")))
    return files(spark, path).select("family", F.explode(_check(F.size(line) % 3 == 0, "not three lines a pair", rows)).alias("r")).select("family", "r.*")


def read_log_likelihood(spark: SparkSession, path: str) -> DataFrame:
    """(family, total, sites): the total on the first line, optionally `N sites` and N values."""
    line = _lines("text")
    values = F.when(F.size(line) > 2, F.transform(F.split(F.trim(line[2]), r"\s+"), lambda v: v.cast("double")))
    return files(spark, path).select("family", line[0].cast("double").alias("total"), values.alias("sites"))


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """(family, seq_name, seq): `N L`, then a name and a sequence a line, blanks in it ignored."""
    line = F.filter(_lines("text"), lambda v: F.trim(v) != "")
    n = F.split(F.trim(line[0]), r"\s+")[0].cast("int")
    rows = F.filter(line, lambda v, k: k > 0)
    out = files(spark, path).select("family", F.explode(_check(F.size(rows) == n, "wrong number of sequences", rows)).alias("r"))
    return out.select("family", F.regexp_extract("r", r"^\s*(\S+)", 1).alias("seq_name"), F.regexp_replace(F.regexp_extract("r", r"^\s*\S+\s+(.*)$", 1), r"\s+", "").alias("seq"))


def phylip_text(msa: DataFrame) -> DataFrame:
    record = F.struct("seq_name", F.concat_ws(" ", F.col("seq_name").cast("string"), "seq").alias("t"))
    by = msa.groupBy("family").agg(F.array_sort(F.collect_list(record)).alias("r"), F.max(F.length("seq")).alias("w"))
    return by.select("family", F.concat(F.size("r").cast("string"), F.lit(" "), F.col("w").cast("string"), F.lit("\n"), F.array_join(F.transform("r", lambda r: r["t"]), "\n"), F.lit("\n")).alias("text"))


def read_nexus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(family, seq_name, seq) of the matrix, and (family, locus, start, end) of the character sets, 1-based, inclusive."""
    f = files(spark, path)
    block = F.regexp_extract("text", r"(?is)matrix\s*\n(.*?);", 1)
    rows = f.select("family", F.explode(F.filter(F.split(block, "\n"), lambda v: F.trim(v) != "")).alias("r"))
    msa = rows.select("family", F.regexp_extract("r", r"^\s*'?([^'\s]+)'?\s", 1).alias("seq_name"), F.regexp_replace(F.regexp_extract("r", r"^\s*\S+\s+(.*)$", 1), r"\s", "").alias("seq"))
    sets = f.select("family", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)charset\s+\S+\s*=\s*\d+\s*-\s*\d+"), F.lit(0))).alias("s"))
    part = lambda k: F.regexp_extract("s", r"(?i)charset\s+(\S+)\s*=\s*(\d+)\s*-\s*(\d+)", k)
    return msa, sets.select("family", part(1).alias("locus"), part(2).cast("int").alias("start"), part(3).cast("int").alias("end"))


def split_loci(msa: DataFrame, sets: DataFrame) -> DataFrame:
    """(family, seq_name, seq) with a family for each locus of a concatenated alignment."""
    part = F.col("seq").substr(F.col("start"), F.col("end") - F.col("start") + 1)
    return msa.join(F.broadcast(sets), "family").select(F.concat_ws("_", "family", "locus").alias("family"), "seq_name", part.alias("seq"))


def stockholm_text(msa: DataFrame, newick: DataFrame) -> DataFrame:
    """(family, text): an alignment and its tree (family, newick) in Stockholm format."""
    record = F.struct("seq_name", F.concat_ws(" ", F.col("seq_name").cast("string"), "seq").alias("t"))
    by = msa.groupBy("family").agg(F.array_sort(F.collect_list(record)).alias("r")).join(newick, "family")
    return by.select("family", F.concat(F.lit("# STOCKHOLM 1.0\n#=GF NH "), "newick", F.lit("\n"), F.array_join(F.transform("r", lambda r: r["t"]), "\n"), F.lit("\n//\n")).alias("text"))


def stockholm_by_rate(msa: DataFrame, edges: DataFrame, rates: DataFrame, states: list[str], missing: str = "*") -> DataFrame:
    """(family, text): for each family and each different rate of its sites (family, site, rate), in ascending order from
    0, a Stockholm text `<family>_<k>` of those sites and of the tree with branches that many times as long.

    Nodes' names follow their text's, states that are none are marked missing.
    """
    from strandmill.operators.alignments import site_subset, with_missing
    from strandmill.sources.newick import to_newick

    category = F.dense_rank().over(Window.partitionBy("family").orderBy("rate")) - 1
    own = rates.withColumn("fake", F.concat_ws("_", "family", category.cast("string")))
    number = F.row_number().over(Window.partitionBy("fake").orderBy("site")) - 1
    scales = own.groupBy("family", "fake").agg(F.first("rate").alias("rate"))
    named = lambda c: F.concat(F.col("fake"), F.lit("-"), F.col(c).cast("string"))
    each = with_missing(msa, states, missing).join(scales, "family").select(F.col("fake").alias("family"), named("seq_name").alias("seq_name"), "seq")
    part = site_subset(each, own.select(F.col("fake").alias("family"), number.alias("k"), "site"))
    trees = edges.join(scales, "family").select(F.col("fake").alias("family"), named("parent").alias("parent"), named("child").alias("child"), "child_ord", (F.col("length") * F.col("rate")).alias("length"))
    return stockholm_text(part, to_newick(trees))


def read_backbone(spark: SparkSession, path: str) -> DataFrame:
    """(family, site, N, CA, C) of residues with all three atoms, numbered in order of their lines; atoms are structs x, y, z."""
    atoms = _atoms(spark, path).where(F.col("atom").isin("N", "CA", "C"))
    of = lambda a: F.max(F.when(F.col("atom") == a, F.struct("x", "y", "z"))).alias(a)
    rows = atoms.groupBy("family", "chain", "residue", "insertion").agg(of("N"), of("CA"), of("C"), F.min("line").alias("line")).where("N is not null and CA is not null and C is not null")
    site = F.row_number().over(Window.partitionBy("family").orderBy("line")) - 1
    return rows.select("family", site.alias("site"), "N", "CA", "C")


def _atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of a file's first model, of those in several places the place that comes first; line is that line's number."""
    model = F.substring_index(F.concat(F.lit("\n"), "text"), "\nENDMDL", 1)
    line = files(spark, path).select("family", F.posexplode(_lines(model)).alias("line", "l")).where("l like 'ATOM  %'")
    at = lambda a, b: F.trim(F.substring("l", a, b - a + 1))
    parts = {"chain": at(22, 22), "residue": at(23, 26).cast("int"), "insertion": at(27, 27), "atom": at(13, 16)}
    place = F.struct("line", at(18, 20).alias("name"), *[at(a, a + 7).cast("double").alias(c) for a, c in ((31, "x"), (39, "y"), (47, "z"))])
    first = line.select("family", *[c.alias(k) for k, c in parts.items()], place.alias("place")).groupBy("family", *parts).agg(F.min("place").alias("place"))
    return first.select("family", "chain", "residue", "insertion", "place.name", "atom", "place.x", "place.y", "place.z", "place.line")


def read_pdb_atoms(spark: SparkSession, path: str, atom: str = "CB") -> DataFrame:
    """(family, chain, residue, insertion, name, x, y, z) of one atom of each residue (CA for glycine), from fixed columns."""
    row = _atoms(spark, path)
    return row.where((F.col("atom") == atom) | ((F.col("name") == "GLY") & (F.col("atom") == "CA"))).drop("atom", "line")


def historian_json(states: list[str], q, pi) -> str:
    """A rate model as JSON: root probabilities and rates between different states."""
    return json.dumps({"alphabet": "".join(states), "rootprob": dict(zip(states, map(float, pi), strict=True)), "subrate": {a: {b: float(q[i][j]) for j, b in enumerate(states) if i != j} for i, a in enumerate(states)}})


def from_historian_json(text: str) -> tuple[list[str], list[list[float]], list[float]]:
    model = json.loads(text)
    states = list(model["alphabet"])
    q = [[0.0 if a == b else float(model["subrate"].get(a, {}).get(b, 0.0)) for b in states] for a in states]
    for i, row in enumerate(q):
        row[i] = -sum(row)
    return states, q, [float(model["rootprob"][s]) for s in states]


def paml_text(states: list[str], q, pi) -> str:
    """Lower triangle of exchangeabilities and the stationary distribution."""
    rows = [" ".join(f"{q[i][j] / pi[j]:.10g}" for j in range(i)) for i in range(1, len(states))]
    return "\n".join([*rows, "", " ".join(f"{p:.10g}" for p in pi)]) + "\n"


def fasttree_text(states: list[str], q, pi) -> str:
    """Rates from the column's to the row's state, and the stationary distribution as the last column."""
    head = "\t".join(["", *states, "*"])
    rows = ["\t".join([b, *(f"{q[i][j]:.10g}" for i in range(len(states))), f"{pi[j]:.10g}"]) for j, b in enumerate(states)]
    return "\n".join([head, *rows]) + "\n"


def from_paml_text(text: str, states: list[str], rate: float | None = None) -> tuple[list[list[float]], list[float]]:
    """Rates and stationary distribution of paml_text(); scaled to a mutation rate if one is given."""
    numbers = [float(v) for v in text.split()]
    n = len(states)
    if len(numbers) != n * (n - 1) // 2 + n:
        raise ValueError(f"{len(numbers)} numbers do not make a matrix of {n} states")
    pi, q = numbers[-n:], [[0.0] * n for _ in range(n)]
    at = iter(numbers)
    for i in range(n):
        for j in range(i):
            q[i][j] = q[j][i] = next(at)
    for i in range(n):
        q[i] = [v * p for v, p in zip(q[i], pi, strict=True)]
        q[i][i] = -sum(v for j, v in enumerate(q[i]) if j != i)
    factor = 1.0 if rate is None else rate / -sum(p * q[i][i] for i, p in enumerate(pi))
    return [[v * factor for v in row] for row in q], pi


def xrate_text(states: list[str], q, pi) -> str:
    """A rate model as a grammar of one chain: nested lists, states in small letters."""
    low = [s.lower() for s in states]
    rules = [
        "(transform (from (Start)) (to (S0)) (prob 0.5))",
        "(transform (from (Start)) (to ()) (prob 0.5))",
        "(transform (from (S0)) (to (A0 S0*)) (gaps-ok)\n  (minlen 1))",
        "(transform (from (S0*)) (to ()) (prob 0.5))",
        "(transform (from (S0*)) (to (S0)) (prob 0.5))",
    ]
    starts = [f"  (initial (state ({a})) (prob {float(p)}))" for a, p in zip(low, pi, strict=True)]
    moves = [f"  (mutate (from ({a})) (to ({b})) (rate {float(q[i][j])}))" for i, a in enumerate(low) for j, b in enumerate(low) if i != j]
    chain = [" (chain", "  (update-policy rev)", "  (terminal (A0))", *starts, *moves, " )"]
    head = ["(grammar", " (name nullprot)", " (update-rates 1)", " (update-rules 1)", *(f" {r}" for r in rules)]
    return "\n".join([*head, *chain, ")", "(alphabet", " (name Protein)", f" (token ({' '.join(low)}))", " (wildcard *)", ")", ""])


def from_xrate_text(text: str, states: list[str]) -> list[list[float]]:
    """Rates of a grammar's mutate rules."""
    at = {s.lower(): k for k, s in enumerate(states)}
    q = [[0.0] * len(states) for _ in states]
    for a, b, rate in re.findall(r"\(mutate\s+\(from\s+\((\S)\)\)\s+\(to\s+\((\S)\)\)\s+\(rate\s+([^\s)]+)\)", text):
        q[at[a.lower()]][at[b.lower()]] = float(rate)
    for i, row in enumerate(q):
        row[i] = -sum(row)
    return q
