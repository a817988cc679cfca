"""The data source gives what the functions give, opens only the files asked for, and commits all or nothing."""

import os

import pytest

from strandmill.sources import datasource
from strandmill.sources import formats as S

TEXTS = {
    "msa": {"a": ">s\nAC-T\n>t\nACGT\n", "b": ">u\nAA\n", "none": ""},
    "tree": {"a": "3 nodes\nr\nx\ny\n2 edges\nr x 0.5\nr y 0.25\n", "b": "1 nodes\nr\n0 edges\n"},
    "site_rates": {"a": "3 sites\n1.0 0.5 2.0\n", "b": "1 sites\n1.5\n"},
    "sites_subset": {"a": "2 sites\n4 1\n", "b": "0 sites\n\n"},
    "contact_map": {"a": "2 sites\n11\n10\n", "b": "1 sites\n0\n"},
    "transitions": {"a": "2 transitions\nAC AG 0.5\nAA AA 1.0\n", "b": "1 transitions\nC C 2.0\n"},
}
READERS = {"msa": S.read_msa, "tree": S.read_tree, "site_rates": S.read_site_rates, "sites_subset": S.read_sites_subset, "contact_map": S.read_contact_map, "transitions": S.read_transitions}


@pytest.fixture
def folder(spark, tmp_path):
    datasource.register(spark)

    def put(kind, **more):
        at = tmp_path / kind
        at.mkdir()
        for family, text in (TEXTS[kind] | more).items():
            (at / f"{family}.txt").write_text(text)
        return str(at)

    return put


@pytest.mark.parametrize("kind", list(TEXTS))
def test_same_rows_and_back(spark, folder, tmp_path, kind):
    at = folder(kind)
    found = spark.read.format("families").option("kind", kind).option("per_partition", 1).load(at)
    want = READERS[kind](spark, at) if "none" not in TEXTS[kind] else READERS[kind](spark, at).where("family <> 'none'")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.columns == want.columns
    assert found.rdd.getNumPartitions() >= 2
    if kind == "contact_map":
        with pytest.raises(Exception, match="only read"):
            found.write.format("families").option("kind", kind).mode("append").save(str(tmp_path / "out"))
        return
    order = [c for c in found.columns if c in ("site", "k", "tid", "child_ord", "seq_name")]
    rows = found.repartition(2, "family").sortWithinPartitions("family", *order)
    out = str(tmp_path / "out")
    os.mkdir(out)
    rows.write.format("families").option("kind", kind).mode("append").save(out)
    assert sorted(os.listdir(out)) == [f"{f}.txt" for f in sorted({r.family for r in found.collect()})]
    again = spark.read.format("families").option("kind", kind).load(out)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))


def test_only_files_asked_for(spark, folder):
    at = folder("msa", broken="no record\n")
    read = spark.read.format("families").option("kind", "msa")
    assert {r.seq for r in read.option("families", '["b"]').load(at).collect()} == {"AA"}
    both = spark.read.format("families").option("kind", "msa").option("families", '["a", "b"]').load(at)
    assert both.where("seq_name <> 's'").count() == 2
    assert sorted(r.family for r in both.where("family = 'a'").union(both.where("family = 'b'")).collect()) == ["a", "a", "b"]
    assert spark.read.format("families").option("kind", "msa").option("families", "[]").load(at).count() == 0
    rows = spark.read.format("families").option("kind", "msa").load(at)
    with pytest.raises(Exception, match="not two-line FASTA: broken"):
        rows.count()
    with pytest.raises(Exception, match="no kind"):
        spark.read.format("families").option("kind", "other").load(at)


def test_all_or_nothing(spark, folder, tmp_path):
    at = folder("site_rates")
    kind = "family string, site int, rate double"
    write = lambda df, mode: df.write.format("families").option("kind", "site_rates").mode(mode).save(at)
    with pytest.raises(Exception, match="exist already"):
        write(spark.createDataFrame([("a", 0, 9.0), ("c", 0, 1.0)], kind).coalesce(1), "append")
    with pytest.raises(Exception, match="several partitions|not together"):
        write(spark.createDataFrame([("c", k, 1.0) for k in range(8)], kind).repartition(4), "append")
    assert sorted(os.listdir(at)) == ["a.txt", "b.txt"]
    write(spark.createDataFrame([("c", 0, 1.0)], kind).coalesce(1), "overwrite")
    assert sorted(os.listdir(at)) == ["c.txt"] and open(f"{at}/c.txt").read() == "1 sites\n1.0\n"
