from collections import Counter

import numpy as np
import pandas as pd

from strandmill.operators import cherries as C

NT, MSA = list("ACGT"), "family string, seq_name string, seq string"
Q = np.array([[-1.0, 0.6, 0.2, 0.2], [0.6, -1.0, 0.2, 0.2], [0.2, 0.2, -1.0, 0.6], [0.2, 0.2, 0.6, -1.0]])


def test_rounds_write_few_tables(spark, monkeypatch):
    """A round of dividing writes two tables, one of lengths and rates a single one."""
    rng = np.random.default_rng(8)
    msa = spark.createDataFrame([(f"f{k % 2}", f"s{k:03}", "".join(rng.choice(NT, 30))) for k in range(90)], MSA)
    names, real = Counter(), C.written
    monkeypatch.setattr(C, "written", lambda df, name, *by: names.update([name]) or real(df, name, *by))
    edges, rates = C.fast_cherries(msa, NT, Q, n_rates=4, whole=0, whole_set=8)
    assert edges.where("child like 's%'").count() == 90 and rates.count() == 2
    assert names["sets"] > 3 and names["drawn"] == names["sets"]
    assert names["categories"] > 2 and names["lengths"] == 1
    assert set(names) == {"sequences", "sets", "drawn", "pairs", "leftovers", "categories", "lengths", "rates"}


def test_rows_are_compared_whatever_their_families(monkeypatch):
    rng = np.random.default_rng(9)
    rows = [rng.integers(-1, 4, (2, w)).astype(np.int8) for w in (5, 0, 9, 5, 9, 9, 5)]
    want = [C._distances(x[:1], x[1])[0] for x in rows]
    for most in (1 << 24, 10):
        monkeypatch.setattr(C, "COMPARED_BYTES", most)
        got = C._apart(*(pd.Series([x[k].tobytes() for x in rows]) for k in (0, 1)))
        assert np.allclose(got, want)


def test_family_of_one_sequence_keeps_its_rates(spark):
    rows = [("one", "a", "ACGT"), ("two", "b", "ACGA"), ("two", "c", "ACCA")]
    both = [C.fast_cherries(spark.createDataFrame(rows, MSA), NT, Q, n_rates=4, whole=whole) for whole in (0, 1 << 24)]
    for edges, rates in both:
        assert {r.family: len(r.rates) for r in rates.collect()} == {"one": 4, "two": 4}
        assert rates.where("family = 'one'").first().rates == [1.0] * 4
        assert [tuple(e) for e in edges.where("family = 'one'").collect()] == [("one", "root", "a", 0, 1.0)]


def test_query_keeps_a_label_of_one_vector(spark, tmp_path):
    from strandmill.plans.catalog import QUERIES

    rng = np.random.default_rng(10)
    rows = [(k, rng.normal(0, 0.1, 64).tolist(), int(k > 0)) for k in range(6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["fast_cherries_in_rounds"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("0", 1, 1, 1, 0, 64, 1.0), ("1", 5, 5, 1, 2, 64, 1.0)]
    assert dict(got.dtypes)["pairs"] == "bigint"
