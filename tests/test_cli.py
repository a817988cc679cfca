from strandmill.__main__ import main


def test_learn_and_evaluate(spark, tmp_path):
    msa = tmp_path / "msa"
    msa.mkdir()
    (msa / "f1.txt").write_text(">a\nACGTACGTAC\n>b\nACGTACGTAA\n>c\nTTGTACGAAC\n>d\nTTGTACGATC\n>e\nCCGTACGATC\n")
    out = tmp_path / "q.txt"
    main(["learn", "--msa", str(msa), "--states", "ACGT", "--epochs", "3", "--output", str(out)])
    assert out.read_text().splitlines()[0].split() == list("ACGT")
    main(["evaluate", "--msa", str(msa), "--states", "ACGT", "--matrix", str(out), "--output", str(tmp_path / "ll")])
    row = spark.read.parquet(str(tmp_path / "ll")).first()
    assert row.n_sites == 10 and row.ll < 0
