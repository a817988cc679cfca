import pandas as pd
import pytest

from fixtures import TREE, edge_rows
from strandmill.plans import cache
from strandmill.sources import formats as S
from strandmill.sources import newick


def put(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.txt").write_text(text)
    return str(folder)


def test_msa_round_trip(spark, tmp_path):
    path = put(tmp_path / "msa", fam1=">b\nAC-\n>a\nGGT\n", fam2=">x\nTT\n")
    rows = S.read_msa(spark, path)
    assert sorted(tuple(r) for r in rows.collect()) == [("fam1", "a", "GGT"), ("fam1", "b", "AC-"), ("fam2", "x", "TT")]
    assert {r.family: r.text for r in S.msa_text(rows).collect()}["fam1"] == ">a\nGGT\n>b\nAC-\n"
    S.write_files(S.msa_text(rows), str(tmp_path / "out"))
    assert ">a\nGGT" in "".join(p.read_text() for p in (tmp_path / "out" / "family=fam1").glob("part-*"))
    with pytest.raises(Exception, match="FASTA"):
        S.read_msa(spark, put(tmp_path / "bad", fam="a\nAC\n")).collect()


def test_tree_round_trip(spark, tmp_path):
    edges = spark.createDataFrame(list(edge_rows("f", TREE)), "family string, parent string, child string, child_ord int, length double")
    text = S.tree_text(edges).first().text
    again = S.read_tree(spark, put(tmp_path / "tree", f=text))
    key = lambda df: sorted(tuple(r) for r in df.select("family", "parent", "child", "child_ord", "length").collect())
    assert key(again) == key(edges)
    with pytest.raises(Exception, match="number of edges"):
        S.read_tree(spark, put(tmp_path / "bad", f="2 nodes\na\nb\n2 edges\na b 1\n")).collect()


def test_newick_round_trip(spark):
    text = "((a:1,b:2)x:0.5,('c d':1,e:3):0.25,f:7);"
    edges = newick.parse(text)
    assert ("internal-0", "x", 0, 0.5) in edges and ("internal-1", "c d", 0, 1.0) in edges
    frame = pd.DataFrame(edges, columns=["parent", "child", "child_ord", "length"])
    assert newick.parse(newick.render(frame).replace("c d", "'c d'")) == edges
    two = newick.parse(text, resolve_root=True)
    assert sum(p == "internal-0" for p, *_ in two) == 2
    back = newick.to_newick(newick.read_newick(spark.createDataFrame([("f", text)], "family string, newick string"))).first()
    assert back.newick.endswith("internal-0;")
    with pytest.raises(ValueError, match="parenthesis"):
        newick.parse("((a,b);")


def test_numbers_maps_and_matrices(spark, tmp_path):
    rates = S.read_site_rates(spark, put(tmp_path / "rates", f="3 sites\n0.5 1 2.25\n"))
    assert [r.rate for r in rates.orderBy("site").collect()] == [0.5, 1, 2.25]
    assert S.numbers_text(rates, "site", "rate").first().text == "3 sites\n0.5 1.0 2.25"
    with pytest.raises(Exception, match="wrong number"):
        S.read_site_rates(spark, put(tmp_path / "bad", f="2 sites\n1\n")).collect()
    assert S.read_sites_subset(spark, put(tmp_path / "none", f="0 sites\n\n")).count() == 0
    near = S.read_contact_map(spark, put(tmp_path / "map", f="2 sites\n10\n11\n"))
    assert sorted((r.i, r.j) for r in near.collect()) == [(0, 0), (1, 0), (1, 1)]
    sizes = spark.createDataFrame([("f", 2), ("g", 1)], "family string, n_sites int")
    assert {r.family: r.text for r in S.contact_map_text(near, sizes).collect()} == {"f": "2 sites\n10\n11", "g": "1 sites\n0"}
    q = S.read_matrix(spark, put(tmp_path / "q", f="\tA\tNA\nA\t-1\t1\nNA\t2\t-2\n"))
    assert {(r.x, r.y): r.q for r in q.collect()}[("NA", "A")] == 2
    again = S.read_matrix(spark, put(tmp_path / "q2", f=S.matrix_text(q).first().text))
    assert sorted(map(tuple, q.drop("family").collect())) == sorted(map(tuple, again.drop("family").collect()))
    pi = S.read_distribution(spark, put(tmp_path / "pi", f="state\tprob\nA\t0.25\nB\t0.75\n"))
    assert {r.state: r.prob for r in pi.collect()} == {"A": 0.25, "B": 0.75}
    with pytest.raises(Exception, match="sum to 1"):
        S.read_distribution(spark, put(tmp_path / "pi2", f="state\tprob\nA\t0.25\n")).collect()


def test_count_matrices_round_trip(spark, tmp_path):
    counts = spark.createDataFrame([(0, "A", "B", 2.0), (1, "B", "B", 0.5)], "bucket int, x string, y string, n double")
    text = S.count_matrices_text(counts, ["A", "B"], [0.1, 0.2])
    again = S.read_count_matrices(spark, put(tmp_path / "c", result=text)).where("n > 0").select("bucket", "t", "x", "y", "n")
    assert sorted(map(tuple, again.collect())) == [(0, 0.1, "A", "B", 2.0), (1, 0.2, "B", "B", 0.5)]


def test_other_formats(spark, tmp_path):
    tr = S.read_transitions(spark, put(tmp_path / "tr", f="2 transitions\nAC GC 0.5\nA T 1\n"))
    assert [(r.x, r.y, r.t) for r in tr.orderBy("tid").collect()] == [("AC", "GC", 0.5), ("A", "T", 1.0)]
    ch = S.read_cherries(spark, put(tmp_path / "ch", f="a\nb\n0.5\nc\nd\n1.5\n"))
    assert ch.count() == 2
    ll = S.read_log_likelihood(spark, put(tmp_path / "ll", f="-3.5\n2 sites\n-1.5 -2\n")).first()
    assert ll.total == -3.5 and ll.sites == [-1.5, -2.0]
    ph = S.read_phylip(spark, put(tmp_path / "ph", f="2 4\na  AC GT\nbb ACGA\n"))
    assert sorted((r.seq_name, r.seq) for r in ph.collect()) == [("a", "ACGT"), ("bb", "ACGA")]
    assert S.phylip_text(ph).first().text == "2 4\na ACGT\nbb ACGA\n"
    a3 = put(tmp_path / "a3", f=">a\nACgg-T\n")
    assert S.read_a3m(spark, a3).first().seq == "AC-T" and S.read_a3m(spark, a3, True).first().seq == "ACGGT"
    nexus = "#NEXUS\nbegin data;\nmatrix\n a ACGT\n b TTTT\n;\nend;\nbegin sets;\ncharset one = 1-3;\ncharset two = 4 - 4;\nend;\n"
    msa, sets = S.read_nexus(spark, put(tmp_path / "nx", f=nexus))
    assert sorted((r.family, r.seq_name, r.seq) for r in S.split_loci(msa, sets).collect()) == [("f_one", "a", "ACG"), ("f_one", "b", "TTT"), ("f_two", "a", "T"), ("f_two", "b", "T")]
    atom = "ATOM      2  CB  ALA A   7      11.104   6.134  -6.504  1.00  0.00           C\nATOM      3  CA  GLY A   8       1.000   2.000   3.000  1.00  0.00           C\n"
    assert [(r.residue, r.x) for r in S.read_pdb_atoms(spark, put(tmp_path / "pdb", f=atom)).orderBy("residue").collect()] == [(7, 11.104), (8, 1.0)]
    states, q, pi = S.from_historian_json(S.historian_json(["A", "B"], [[-1, 1], [2, -2]], [2 / 3, 1 / 3]))
    assert (states, q) == (["A", "B"], [[-1.0, 1.0], [2.0, -2.0]]) and sum(pi) == pytest.approx(1)
    assert S.paml_text(["A", "B"], [[-1, 1], [2, -2]], [0.5, 0.5]).startswith("4") and S.fasttree_text(["A", "B"], [[-1, 1], [2, -2]], [0.5, 0.5]).splitlines()[1] == "A\t-1\t2\t0.5"


def test_cache_makes_once(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3).toDF("n")
    for _ in range(2):
        assert cache.cached(spark, str(tmp_path), "op", make, a=1).count() == 3
    assert len(calls) == 1
    families = spark.createDataFrame([("a", 1), ("b", 2)], "family string, v int")
    assert cache.cached_by_family(spark, str(tmp_path), "fam", families.limit(1), lambda d: d, k=1).count() == 1
    assert cache.cached_by_family(spark, str(tmp_path), "fam", families, lambda d: d, k=1).count() == 2
