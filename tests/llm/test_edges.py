"""Nulls in any column, empty and very long texts, repeated rows, empty tables and clashing names, for every operator."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from strandmill.llm import _pieces, decontamination, embedding_links, grammar_shards, pii, quality, sentencepiece_codec, simhash, substring, token_counts, toxicity
from strandmill.llm._bytes import text_bytes, word_hashes
from strandmill.llm._shared import joined

DATA = "/root/testdata/sf0.001"
PIECES, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
#: Documents with more columns, named as the operators name their own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, block string, row string, rep string, component string, perplexity string, ids string, found string, score string"
LONG = " ".join(f"w{k % 997}x{k % 13}" for k in range(20_000))
TEXTS = [None, "", " \n", "same words in two rows here", "same words in two rows here", LONG, LONG, None, "Ünïcode — 日本語", "one", "call +1-826-555-4081 now"]
IDS = [0, 1, 2, 3, 3, 5, 6, None, None, None, 10]


def docs(spark, texts=TEXTS, ids=IDS):
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "web", None if k % 4 else 5, *"ibrecpifs") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return docs(spark, [], [])


def ids_of(rows, column="id"):
    return Counter(r[column] for r in rows)


def test_every_row_gets_a_row(spark, tmp_path):
    frame = docs(spark)
    trusted = spark.createDataFrame([(3,), (5,), (None,)], "id long")
    items = spark.createDataFrame([(1, "same words in two rows"), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    encoded = sentencepiece_codec.encode(frame, PIECES)
    shards = grammar_shards.write_shards(frame, BYTES, str(tmp_path / "shards"), partition_rows=3)
    results = {
        "op2": simhash.near_duplicates(frame),
        "sets": simhash.similar_texts(frame),
        "op3": token_counts.count_tokens(frame, PIECES),
        "op4": substring.remove_repeats(frame, block_rows=2),
        "op5": grammar_shards.read_shards(shards),
        "op7": decontamination.contamination(frame, items),
        "op8": toxicity.classify(frame, labels),
        "op9": quality.classify(frame, trusted),
        "op10": sentencepiece_codec.decode(encoded, PIECES),
    }
    for name, found in results.items():
        assert ids_of(found.collect()) == Counter(IDS), name
    moved = pii.pseudonymise(frame, "k")
    assert moved.columns == [*frame.columns, "n_pseudonyms"] and ids_of(moved.collect(), "doc_id") == Counter(IDS)


def test_empty_tables_give_empty_results(spark, tmp_path):
    none = empty(spark)
    shards = grammar_shards.write_shards(none, BYTES, str(tmp_path / "none"))
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert grammar_shards.read_shards(shards).count() == 0
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(none, PIECES), PIECES).count() == 0
    assert simhash.similar_texts(none).count() == simhash.keep_one(none).count() == 0
    assert toxicity.classify(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert quality.keep_accepted(none, spark.createDataFrame([], "id long")).count() == 0
    assert embedding_links.links(vectors).count() == 0


def test_shards_of_null_and_repeated_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    shards = grammar_shards.write_shards(docs(spark), BYTES, str(tmp_path / "shards"), partition_rows=3)
    got = sorted((r.id is not None, r.id or 0, r.start, r.n_tokens, r.ids_crc32) for r in grammar_shards.read_shards(shards).collect())
    want = sorted((i is not None, i or 0, len(own), zlib.crc32(np.array(own, "<u4").tobytes())) for i, x in zip(IDS, TEXTS) for own in [t.encode(x or "", add_special_tokens=False).ids + [2]])
    assert sorted((a, b, n, c) for a, b, _, n, c in got) == want
    at = 0
    for _, _, start, n, _ in sorted(got, key=lambda r: r[2]):  # null ids first, and no gaps
        assert start == at
        at += n
    assert [a for a, *_ in sorted(got, key=lambda r: r[2])] == [False] * 3 + [True] * 8


def test_fingerprints_of_null_and_repeated_ids(spark):
    got = sorted(((r.id is not None, r.id or 0, r.fp, r.component) for r in simhash.near_duplicates(docs(spark)).collect()))
    zero = [r for r in got if r[2] == "0" * 16]
    assert [r[1:] for r in zero] == [(0, "0" * 16, 0)] + [(k, "0" * 16, 0) for k in range(3)]
    assert {r[3] for r in got if r[0] and r[1] in (5, 6)} == {5} and {r[3] for r in got if r[0] and r[1] == 3} == {3}


def test_joins_on_hot_and_null_keys(spark, monkeypatch):
    import strandmill.llm._shared as shared

    monkeypatch.setattr(shared, "HOT_ROWS", 7)
    left = spark.createDataFrame([(k, 1 if k % 3 else None if k % 2 else k) for k in range(100)], "n long, key long")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 60, 2)] + [(1, "v1")], "key long, v string")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "key", how).select("n", "key", "v").collect()))
        for rows in (10, 10**9):  # broadcast, and dealt
            assert sorted(map(str, joined(left, right, "key", how, rows).select("n", "key", "v").collect())) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_take_any_rows(spark):
    frame, none = docs(spark), empty(spark)
    rows = {name: stage(spark, frame, DATA) for name, stage in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert rows[name].columns == frame.columns, name
        assert ids_of(rows[name].collect(), "doc_id") <= Counter(IDS), name
        assert stage(spark, none, DATA).count() == 0, name
    kept = [r.text for r in rows["quality classifier"].collect()]
    assert all(t and t.strip("") for t in kept)
    # rows of one id and those without one stay together; the second long text and the empty ones of a larger id go
    assert ids_of(rows["near-duplicates"].collect(), "doc_id") == Counter([0, 3, 3, 5, None, None, None, 10])
    assert ids_of(rows["decontamination"].collect(), "doc_id") == Counter(IDS)
    moved = [r.text for r in rows["pseudonyms"].collect() if r.doc_id == 10]
    assert re.fullmatch(r"call \+1-8\d\d-\d{3}-\d{4} now", moved[0]) and "826-555-4081" not in moved[0]
    last = corpus_pipeline.STAGES[-1][1]
    assert ids_of(last(spark, frame, DATA).collect(), "doc_id") == Counter(IDS) and last(spark, none, DATA).count() == 0


def test_long_texts_are_cut_as_the_library_does(spark):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    least = min(p.score for p in model.pieces if p.score > _pieces.HUGE) - 1
    for p in model.pieces:
        if p.score < _pieces.HUGE:
            p.score = least
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 9))) for _ in range(4000)), LONG[:9000]]
    frame = docs(spark, texts, [1, 2])
    ids = {r.id: r.ids for r in sentencepiece_codec.encode(frame, PIECES).collect()}
    counts = {r.id: r.n_tokens for r in token_counts.count_tokens(frame, PIECES).collect()}
    for k, t in enumerate(texts, 1):
        # the library adds in single precision, so beyond some length it may prefer another of nearly equal cuts
        want = [i for part in t.split(" ") for i in library.encode(part)]
        assert ids[k] == want and counts[k] == len(want)


def plain_logit(net, text):
    """The network's largest logit over the windows of a text, step by step."""
    low = bytearray(text.encode().lower())
    for k in range(1, len(low)):
        if low[k - 1] == 0xC3 and 0x80 <= low[k] <= 0x9E:
            low[k] += 0x20
    words = re.findall(rb"[a-z\x80-\xff]+", bytes(low))
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    mixed = lambda code: (code * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - toxicity._BITS)

    def vector(w):
        h = int(word_hashes(81, np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) >> (64 - toxicity._BITS)
        marked, grams = b" " + w + b" ", []
        for n in toxicity._GRAMS:
            grams += [mixed(int.from_bytes(bytes([n]) + marked[k : k + n], "big")) for k in range(len(marked) - n + 1)]
        mean = p["gram"][grams].mean(axis=0) if grams else np.zeros(toxicity._DIM)
        return np.concatenate([p["word"][h], mean]) @ p["in"] + p["in0"]

    sigmoid, h = lambda v: 1 / (1 + np.exp(-v)), toxicity._HIDDEN
    best, start = -np.inf, 0
    while True:
        window = [vector(w) for w in words[start : start + toxicity.LENGTH]]
        states = np.zeros((len(window), 2 * h))
        for way in (0, 1):
            state = np.zeros(h)
            for k in range(len(window)) if way == 0 else reversed(range(len(window))):
                a, u = window[k][3 * h * way : 3 * h * (way + 1)], state @ p[f"rec{way}"]
                z, r = sigmoid(a[:h] + u[:h]), sigmoid(a[h : 2 * h] + u[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(a[2 * h :] + r * u[2 * h :])
                states[k, h * way : h * (way + 1)] = state
        pool = np.zeros(2 * h)
        if window:
            energy = np.tanh(states @ p["att"] + p["att0"]) @ p["att1"]
            weight = np.exp(energy - energy.max())
            pool = weight / weight.sum() @ states
        best = max(best, float(pool @ p["out"] + p["out0"][0]))
        if start + toxicity.LENGTH >= len(words):
            return best
        start += toxicity.STRIDE


def test_scores_are_those_of_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    net = toxicity.Network(3)
    net.p = {k: (v + rng.normal(size=v.shape) * 0.2).astype(np.float32) for k, v in net.p.items()}
    letters = list("abcdeéÉß")
    texts = ["", "123 !!", "one", "Two WORDS", *(" ".join("".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(n)) for n in (31, 32, 33, 56, 57, 200))]
    seen = toxicity._Texts(*text_bytes(pa.array(texts, pa.large_string())))
    np.testing.assert_allclose(net.worst(seen)[0], [plain_logit(net, t) for t in texts], atol=2e-4)
