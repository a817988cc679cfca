"""Near-ties, models of a file, null sequences, matrices and estimators by name, keys by content, long scoring, late events."""

import datetime
import random

import numpy as np
import pytest

from strandmill.operators import alignments as M
from strandmill.operators import rates as R
from strandmill.operators import sites as S
from strandmill.plans import cache
from strandmill.plans import pipelines as P
from strandmill.sources import formats
from strandmill.streaming import counts as stream

NT = list("ACGT")
MATRIX = "x string, y string, q double"


def test_ranks_do_not_hang_on_the_last_bit(spark):
    base = {("a", "b"): 6.4625850407295555, ("b", "a"): 6.462585040729556, ("a", "c"): 1.0, ("c", "a"): 2.0, ("b", "c"): 3.0, ("c", "b"): 0.5}
    tied = base | {("b", "a"): base["a", "b"]}
    other = {k: v for v, k in enumerate(base, 1)}
    rows = lambda d: spark.createDataFrame([(x, y, float(q)) for (x, y), q in d.items()], MATRIX)
    got, want = (R.correlations(rows(d), rows(other)).first() for d in (base, tied))
    assert got.spearman == want.spearman and np.isclose(got.pearson, want.pearson)


def line(n, atom, alt, name, chain, residue, code, x, y=0.0, z=0.0):
    return f"ATOM  {n:5d}  {atom:<3}{alt}{name} {chain}{residue:4d}{code}   {x:8.3f}{y:8.3f}{z:8.3f}"


def test_first_model_first_place_and_insertions(spark, tmp_path):
    text = ["MODEL        1", line(1, "N", " ", "ALA", "A", 52, " ", 1), line(2, "CA", "A", "ALA", "A", 52, " ", 2), line(3, "CA", "B", "ALA", "A", 52, " ", 99), line(4, "C", " ", "ALA", "A", 52, " ", 3)]
    text += [line(5, "N", " ", "GLY", "A", 52, "A", 4), line(6, "CA", " ", "GLY", "A", 52, "A", 5), line(7, "C", " ", "GLY", "A", 52, "A", 6), "ENDMDL", "MODEL        2"]
    text += [line(k, a, " ", "ALA", "A", 52, " ", 50 + k) for k, a in enumerate(("N", "CA", "C"))] + ["ENDMDL", ""]
    (tmp_path / "f.pdb").write_text("\n".join(text))
    rows = formats.read_backbone(spark, str(tmp_path)).orderBy("site").collect()
    assert [(r.site, r.N.x, r.CA.x, r.C.x) for r in rows] == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)]
    atoms = formats.read_pdb_atoms(spark, str(tmp_path), "CA").orderBy("x").collect()
    assert [(r.residue, r.insertion, r.name, r.x) for r in atoms] == [(52, "", "ALA", 2.0), (52, "A", "GLY", 5.0)]


def test_hamming_of_null_and_many(spark, monkeypatch):
    monkeypatch.setattr(M, "PAIRED", 3)
    rng = np.random.default_rng(0)
    rows = [("f", k, None if k == 4 else "".join(rng.choice(list("ACGT-"), 70))) for k in range(11)]
    got = {(r.x, r.y): r.distance for r in M.hamming_pairs(spark.createDataFrame(rows, "family string, seq_name int, seq string"), NT).collect()}
    assert len(got) == 55
    for (x, y), d in got.items():
        both = [(a, b) for a, b in zip(rows[x][2] or "", rows[y][2] or "", strict=False) if a in NT and b in NT]
        assert x < y and np.isclose(d, sum(a != b for a, b in both) / len(both) if both else 0)


def test_rates_over_and_over(spark):
    rates = spark.createDataFrame([("f", k, v) for k, v in enumerate((1.1, 0.4, 0.7))] + [("g", 0, 2.0)], "family string, site int, rate double")
    got = M.extended_rates(rates, 7).orderBy("family", "site").collect()
    assert [r.rate for r in got] == [1.1, 0.4, 0.7, 1.1, 0.4, 0.7, 1.1] + [2.0] * 7
    assert M.extended_rates(rates, 2).where("family = 'f'").count() == 2


def test_matrices_by_name(spark, tmp_path):
    q = P.named_matrix(spark, "equ", NT).collect()
    assert {(r.x == r.y, round(r.q, 6)) for r in q} == {(True, -1.0), (False, 0.333333)}
    assert P.named_matrix(spark, "equ_x_equ", [a + b for a in NT for b in NT]).count() == 256
    (tmp_path / "m.dat").write_text("1\n2 3\n4 5 6\n\n0.1 0.2 0.3 0.4\n")
    rows = {(r.x, r.y): r.q for r in P.named_matrix(spark, str(tmp_path / "m.dat"), NT, rate=1.0).collect()}
    pi = [0.1, 0.2, 0.3, 0.4]
    assert np.isclose(-sum(p * rows[s, s] for p, s in zip(pi, NT, strict=True)), 1) and np.isclose(rows["A", "C"] / rows["C", "A"], 2)
    (tmp_path / "t.txt").write_text("\tA\tC\nA\t-1.0\t1.0\nC\t2.0\t-2.0\n")
    assert {(r.x, r.y): r.q for r in P.named_matrix(spark, str(tmp_path / "t.txt"), ["A", "C"]).collect()}["C", "A"] == 2.0


def test_estimators_by_name(spark):
    edges = spark.createDataFrame([("f", "r", "a", 0, 0.1), ("f", "r", "b", 1, 0.1)], "family string, parent string, child string, child_ord int, length double")
    rates = spark.createDataFrame([("f", [1.0])], "family string, rates array<double>")
    assert P.estimator(P.Settings(estimator="gt", given=(edges, rates)))(None, NT, None) == (edges, rates)
    for s in (P.Settings(estimator="gt"), P.Settings(estimator="other")):
        with pytest.raises(ValueError, match="estimator"):
            P.estimator(s)


def test_keys_follow_contents(spark, monkeypatch):
    one, two = (spark.createDataFrame([("A", "C", q)], MATRIX) for q in (1.0, 2.0))
    assert cache.key("k", one, a=1) == cache.key("k", one, a=1)
    assert len({cache.key("k", one, a=1), cache.key("k", two, a=1), cache.key("k", one, a=2)}) == 3
    before = cache.key("k", one)
    monkeypatch.setattr(cache, "VERSION", -1)
    assert cache.key("k", one) != before


@pytest.mark.parametrize("gap", [None, "-"])
def test_scoring_dealt_by_transitions(spark, gap):
    states = [*NT, "-"]
    rng = np.random.default_rng(1)
    rows = [("f", k, "".join(rng.choice(list("ACGT-n"), 150 - k % 3)), "".join(rng.choice(list("ACGT-n"), 150)), 0.1 + k / 40) for k in range(40)]
    seqs = spark.createDataFrame(rows, "family string, tid int, x_seq string, y_seq string, t double")
    qs = {}
    for site in range(140):  # the last sites have no model
        q = rng.gamma(2, 0.2, (5, 5))
        np.fill_diagonal(q, 0)
        qs[site] = q - np.diag(q.sum(axis=1))
    models = spark.createDataFrame([("f", s, a, b, float(q[i, j])) for s, q in qs.items() for i, a in enumerate(states) for j, b in enumerate(states)], "family string, site int, x string, y string, q double")
    whole = {(r.tid, r.site): r.ll for r in S.site_model_likelihood(seqs, models, states, gap).collect()}
    dealt = {(r.tid, r.site): r.ll for r in S.site_model_likelihood(seqs, models, states, gap, together=7).collect()}
    assert whole == pytest.approx(dealt) and len(whole) > 1000
    from strandmill.functions.markov import expm

    for tid, site in list(whole)[::97]:
        _, _, x, y, t = rows[tid]
        p = expm(qs[site] * t)[states.index(x[site])]
        b = states.index(y[site])
        want = p[b] if gap is None else 1.0 if b == 4 else p[b] / (1 - p[4])
        assert np.isclose(whole[tid, site], np.log(want))
    counted = sum(1 for r in rows for s in range(140) if s < len(r[2]) and r[2][s] in states and r[3][s] in states)
    assert len(whole) == counted


def test_late_events(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(minutes=k * k % 977), k % 3, "abc"[k % 5 % 3]) for k in range(90)]
    kind = "event_id long, ts timestamp, user_id long, event_type string"
    want = []
    for user in range(3):
        own = sorted((t, k, e) for k, t, u, e in rows if u == user)
        want += [(user, a[2], b[2], (b[0] - a[0]).total_seconds() / 86400) for a, b in zip(own, own[1:], strict=False)]
    random.Random(0).shuffle(rows)
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(-1, start + datetime.timedelta(days=9), -1, "")], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    events = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = stream.run_available(stream.late_transitions(events, "2 days"), "append", str(tmp_path / "out")).collect()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted((r.family, r.x, r.y, round(r.t, 9)) for r in got) == sorted((u, a, b, round(t, 9)) for u, a, b, t in want)
