import os

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    columns, kept = docs.columns, [docs.count()]
    from strandmill.llm._shared import written

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DATA), "stage")
        assert docs.columns == columns, name
        kept.append(docs.count())
        if name == "quality classifier":
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            good = [k for k, r in labels.items() if r.quality == 1]
            bad = [k for k, r in labels.items() if r.quality == 0]
            assert sum(k in ids for k in good) >= 0.95 * len(good) and sum(k in ids for k in bad) <= 0.3 * len(bad)
    assert kept == sorted(kept, reverse=True) and kept[1] < kept[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in last} == text and all(len(r.ids) == r.n_tokens for r in last)


def test_run_returns_the_last_stage(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "ids", "n_tokens", "text"]
