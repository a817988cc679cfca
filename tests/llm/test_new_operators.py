"""Shards, the audit of filters and collocations against plain versions, on awkward tables and larger than their parts."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import collocations, filter_audit, sharding
from strandmill.llm.oracles import ORACLE_SQL
from strandmill.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, number string, shard string, slot string, size string, part string, mask string, n string, id string, block string, k string"
LONG = " ".join(f"w{k % 997}x{k % 13}" for k in range(20_000))
TEXTS = [None, "", " \n", "same text", "same text", "same text", LONG, LONG, None, "Ünïcode — 日本語", "A LOUD ONE #1", "same text", "$", "É" * 50, "one"]
IDS = [0, 1, 2, 7, 3, 3, 5, 6, None, None, 9, None, 10, 10, 10]
LANGS = ["en", None, "en", "de", "en", "en", "de", "de", None, "", "en", "en", None, "de", "en"]


def docs(spark, texts=TEXTS, ids=IDS, langs=LANGS):
    rows = [(i, t, lang, *"nszspmnibk"[: len(SCHEMA.split(",")) - 3]) for i, t, lang in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def labels(spark, rows=((3, 1, 0), (3, 0, 1), (5, 1, None), (None, 1, 1), (77, 1, 1), (10, None, 1))):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 1000, 4096, 4097])
def test_permutation(n):
    p = sharding.Permutation(n, "key")
    places = p.forward(np.arange(n))
    assert sorted(places.tolist()) == list(range(n))
    assert (p.backward(places) == np.arange(n)).all()
    assert n < 24 or (places != sharding.Permutation(n, "other").forward(np.arange(n))).any()


def test_permutation_spreads():
    n = 1 << 16
    places = sharding.Permutation(n, 1).forward(np.arange(n))
    shard = places[: n // 4] % 24  # neighbours go everywhere
    counts = np.bincount(shard, minlength=24)
    assert counts.min() > 0.85 * n / 96 and counts.max() < 1.15 * n / 96
    assert abs(np.corrcoef(np.arange(n), places)[0, 1]) < 0.02
    big = sharding.Permutation((1 << 40) + 3, 1)
    some = np.random.default_rng(0).integers(0, (1 << 40) + 3, 1000)
    assert (big.backward(big.forward(some)) == some).all() and big.forward(some).max() > 1 << 39


def test_shards_of_an_awkward_table(spark):
    got = sharding.shuffled(docs(spark)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(zip(IDS, TEXTS, strict=True))
    assert sorted(r.number for r in got) == list(range(len(TEXTS)))
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.number)]
    assert ordered == sorted(IDS, key=lambda i: (i is not None, i))
    for r in got:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by[k]) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1
    shard, slot = sharding.shard_and_slot(np.array([r.number for r in got]), len(got))
    assert [(r.shard, r.slot) for r in got] == list(zip(shard.tolist(), slot.tolist()))
    assert (sharding.row_number(shard, slot, len(got)) == [r.number for r in got]).all()
    again = sharding.shuffled(docs(spark).repartition(7)).collect()  # the same whatever the partitions, but for rows that are equal
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in got)
    assert sharding.shuffled(docs(spark, [], [], [])).count() == 0


def test_shards_of_one_hot_id(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shuffled(rows, shards=5).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert sorted((r.n, r.d, r.m) for r in got) == [(1000, 1000, 999)] * 5


def test_written_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    back = sharding.write_shards(docs(spark), path, shards=4)
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in back.collect()) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in sharding.shuffled(docs(spark), shards=4).collect())


# the audit


def plain_mask(text, others, doc_id):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    smaller = doc_id is not None and any(i is not None and i < doc_id for i in others)
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), smaller)
    return sum(1 << k for k, f in enumerate(fails) if f)


def plain_audit(rows, said):
    ids = defaultdict(list)
    for i, t, _ in rows:
        ids[t or ""].append(i)
    good, toxic = ({i for i, q, x in said if i is not None and (q if k == 0 else x) == 1} for k in (0, 1))
    by = defaultdict(list)
    for i, t, part in rows:
        by[part or ""].append((plain_mask(t or "", ids[t or ""], i), i in good, i in toxic))
    out = []
    for part, docs_ in by.items():
        mine = []
        for order in itertools.permutations("ABCDE"):
            left = list(docs_)
            for step, c in enumerate(order, 1):
                bit = 1 << "ABCDE".index(c)
                gone = [d for d in left if d[0] & bit]
                left = [d for d in left if not d[0] & bit]
                failing = sum(1 for d in docs_ if d[0] & bit)
                mine.append(["".join(order), step, len(left), len(gone), failing - len(gone), sum(1 for d in docs_ if d[0] == bit), sum(d[1] for d in gone), sum(d[2] for d in gone)])
        total = Counter()
        for r in mine:
            total[r[0][r[1] - 1]] += r[3]
        out += [(part, *r, total[r[0][r[1] - 1]]) for r in mine]
    return sorted(out)


@pytest.mark.parametrize("held", [1, 16 << 20])
def test_audit(spark, monkeypatch, held):
    monkeypatch.setattr(filter_audit, "HELD_BYTES", held)  # in this process only: workers hold what they hold
    said = labels(spark)
    got = sorted(map(tuple, filter_audit.audit(docs(spark), said).collect()))
    assert got == plain_audit(list(zip(IDS, TEXTS, LANGS, strict=True)), [tuple(r) for r in said.collect()])
    assert filter_audit.audit(docs(spark, [], [], []), said).count() == 0


def test_chains_of_one_hash():
    texts = [zlib.compress(t) for t in (b"a", b"b", b"a", b"b", b"a")]
    chains, rows = filter_audit._Chains(), []
    for text, id_ in zip(texts, (5, 1, 3, 2, 3), strict=True):  # all under one hash
        rows += chains.add(0, text, 0, id_, "p", 1)
    rows += [(id_, part, mask, n) for _, _, mask, id_, part, n in chains.smallest()]
    assert sorted(rows) == [(1, "p", 0, 1), (2, "p", 16, 1), (3, "p", 0, 2), (5, "p", 16, 1)]


def test_routing_sends_a_common_text_once_a_task():
    rows = [(k, "en", "common", 99) for k in random.Random(1).sample(range(1000), 1000)]
    sent = list(filter_audit._routed(rows, filter_audit.Limits()))
    assert sum(1 for _, x in sent if x[0] is not None) == 1 and sum(x[4] for _, x in sent) == 1000
    assert len({key for key, x in sent if x[0] is None}) == 999


# collocations


def plain_collocations(rows, least, most_words, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        inside = {q for p, a in frequent.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) for q in [p[i:j]] if a >= frequent[q]}
        rows_ = []
        for p, a in frequent.items():
            if len(p) < 2 or p in inside:
                continue
            score, k = min((1000 * a * n[lang] // (frequent[p[:k]] * frequent[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), frequent[p[:k]], frequent[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def prose():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(12)] + ["Ünï", "日本", "\x00odd", "\x1cseparated", "nbsp\xa0word", "W3"]
    rows = [(None, None), ("", "en"), ("...", "en"), ("a a a a a a a a", "en"), ("alone", "xx")]
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", ", ", "  "]) for _ in range(rng.randrange(60)))
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    rows.append((" ".join(rng.choice(words) for _ in range(3000)), "de"))
    return rows


@pytest.mark.parametrize(("block_bytes", "entries", "share_blocks"), [(8 << 20, 1 << 18, 1 << 20), (300, 50, 4)], ids=["one block a task", "many blocks, buckets and shares"])
def test_collocations(spark, block_bytes, entries, share_blocks):
    rows = prose()
    table = spark.createDataFrame([(t, lang, "p", 1, "q") for t, lang in rows], "text string, lang string, part string, n int, phrase string").repartition(3)
    got = collocations.collocations(table, 4, 5, 40, block_bytes=block_bytes, entries=entries, share_blocks=share_blocks)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 4, 5, 40)


def test_long_text_is_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "_CHUNK", 50)
    text = "One two, three. " * 40 + "x" * 200 + ";tail"
    assert b"\xff".join(collocations._chunks(text)) == text.encode().translate(collocations._TABLE)
    assert len(list(collocations._chunks(text))) > 5


def test_no_collocations(spark):
    table = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(table).count() == 0
    assert collocations.collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string")).count() == 0


def test_first_of_many(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RANKED_ROWS", 50)
    rows = spark.range(2000).select(F.lit("p").alias("part"), F.format_string("w%04d", "id").alias("phrase"), F.lit(1).alias("a"), F.lit(1).alias("l"), F.lit(1).alias("r"), F.lit(1).alias("n"), (F.col("id") % 7).alias("score"))
    got = [(r.rank, r.phrase) for r in collocations.ranked(rows, 10).orderBy("rank").collect()]
    assert got == list(enumerate([f"w{k:04d}" for k in range(6, 76, 7)], 1))


def test_exact_arithmetic(spark):
    big = 4_000_000_000_000
    row = spark.createDataFrame([(big, [big + 1, big], [big + 3, big], 9 * big)], "a long, heads array<long>, tails array<long>, n long")
    got = row.select(collocations._score(2).alias("s")).select("s.*").first()
    assert got.score == 1000 * big * 9 * big // ((big + 1) * (big + 3)) and (got.l, got.r) == (big + 1, big + 3)


@pytest.mark.parametrize("name", ["op11_feistel_shards", "op12_filter_interaction", "op13_positional_collocations"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas().astype(object), con.execute(ORACLE_SQL[name]).df().astype(object)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda x: sorted(str(["" if v is None or v != v else v for v in r]) for r in x[sorted(x.columns)].where(x.notna(), None).itertuples(index=False))
    assert rows(got) == rows(want)
