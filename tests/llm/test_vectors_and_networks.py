import math

import numpy as np
import pyarrow as pa
import pytest

from strandmill.llm import embedding_links as V
from strandmill.llm import toxicity as T
from strandmill.llm._bytes import text_bytes
from strandmill.llm._shared import connected_components


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((150, 32))
    near = [b + rng.standard_normal(32) * s for b in base[:30] for s in (0.02, 0.05, 0.1)]
    dense = base[0] + rng.standard_normal((90, 32)) * 0.03
    rows = [v.astype(np.float32).tolist() for v in [*base, *near, *dense]]
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], None, [0.0] * 32, [math.nan] + rows[2][1:], [math.inf] + rows[3][1:], [None] + rows[4][1:], [], rows[5][:16]]
    frame = spark.createDataFrame([(k, v, "x", 1) for k, v in enumerate(rows)], "vec_id long, embedding array<float>, key string, weight int")
    unit = np.array([np.array(v, float) / np.linalg.norm(v) if v and len(v) == 32 and None not in v and np.isfinite(v).all() and np.any(v) else np.full(32, np.nan) for v in rows])
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    least = np.arange(len(rows))
    for _ in range(len(rows)):
        least = np.array([min([least[k], *least[linked[k]]]) for k in range(len(rows))])
    for bucket in (2048, 40):  # whole cells, and cells dealt into blocks
        got = {r.id: (r.n_links, r.component) for r in V.links(frame, bucket=bucket).collect()}
        assert len(got) == len(rows)
        recall = sum(got[k][0] for k in got) / linked.sum()
        assert 0.99 <= recall <= 1
        assert all(got[k][0] <= n for k, n in enumerate(linked.sum(axis=1)))
        assert [got[k][1] for k in range(len(rows))] == least.tolist()
    assert V.links(frame.limit(0)).count() == 0


def test_short_and_long_vectors_side_by_side(spark):
    """Near pairs of two lengths whose cells come in one batch, repeated rows and rows without an id."""
    rng = np.random.default_rng(5)
    rows = []
    for dim in (16, 64, 16, 64):
        base = rng.standard_normal(dim)
        rows += [base.tolist(), (base + 0.01 * rng.standard_normal(dim)).tolist()]
    ids = [*range(8), None, 9]
    rows += [rows[0], rows[2]]
    frame = spark.createDataFrame(list(zip(ids, rows)), "vec_id long, embedding array<double>").coalesce(1)
    got = {r.id: (r.n_links, r.component) for r in V.links(frame).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 2), 3: (2, 2), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), None: (2, 0), 9: (2, 2)}


def test_calibration():
    assert V.tables_for(0.95, 0.999) > V.tables_for(0.95, 0.9) and V.tables_for(0.99) < V.tables_for(0.95)
    rng = np.random.default_rng(2)
    a = rng.standard_normal((400, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.standard_normal(a.shape)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * noise
    lines = V._Lines.of(48, V.tables_for())
    assert (lines.cells(a) == lines.cells(b)).any(axis=1).mean() > 0.98
    count = (np.abs(a @ lines.counted - b @ lines.counted) <= V.WINDOW).sum(axis=1)
    assert (count >= V.collisions_for()).mean() > 0.99


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(5, 5), (3, 1), (1, 3), (3, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 7 for k in range(7, 60)} | {1: 1, 3: 1}


def toxic_rows(n, rng):
    words = np.array([a + b for a in ("th", "er", "on", "in", "be") for b in ("at", "ou", "le", "ing", "es")])
    rows = []
    for k in range(n):
        text = rng.choice(words, rng.integers(5, 150)).tolist()
        if bad := k % 4 == 0:
            for _ in range(3):
                text.insert(int(rng.integers(0, len(text))), rng.choice(["vileworm", "Vilewormly", "SCUMBALL!!"]))
        rows.append((k, " ".join(text), int(bad)))
    return rows


def test_gradients():
    net = T.Network()
    buf, bounds = text_bytes(pa.array(["one two three vile", "", "some other words " * 30], pa.large_string()))
    texts = T._Texts(buf, bounds)
    windows, y = np.arange(len(texts.text)), (texts.text == 0).astype(float)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g = net.gradients(texts, windows, y)

    def loss():
        z = net.forward(net.inputs(texts)[1], texts.places(windows))
        return np.mean(np.logaddexp(0, z) - y * z)

    for name, value in net.p.items():
        at = np.unravel_index(np.argmax(np.abs(g[name])), value.shape)
        was, step = value[at], 1e-3
        value[at] = was + step
        up = loss()
        value[at] = was - step
        down = loss()
        value[at] = was
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=1e-2, abs=1e-5)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        buf, bounds = text_bytes(pa.array([" ".join(["w"] * n)], pa.large_string()))
        texts = T._Texts(buf, bounds)
        seen = {k for s, m in zip(texts.start, texts.size) for k in range(s, s + m)}
        assert seen == set(range(n)) and len(texts.text) >= 1


def test_held_out_accuracy(spark):
    rows = toxic_rows(900, np.random.default_rng(3)) + [(900, None, 0), (901, "", 0), (902, "123 456", 0)]
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t, _ in rows], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    got = {r.id: r for r in T.classify(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [(r.predicted, y) for i, _, y in rows if (r := got[i]).held_out]
    assert 200 < len(held) < 400 and np.mean([p == y for p, y in held]) > 0.97
    assert got[901].predicted == 0


def test_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.classify(docs, none).collect()] == pytest.approx([0, 0], abs=1e-9)
    ones = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "doc_id long, toxic int")
    assert [r.score for r in T.classify(docs, ones).collect()] == pytest.approx([1, 1], abs=1e-9)
    assert T.classify(docs.limit(0), none).count() == 0


def test_links_of_null_ids_and_clashing_names(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(32)
    near = [(base + rng.standard_normal(32) * 0.02).astype(np.float32).tolist() for _ in range(3)]
    far = rng.standard_normal((2, 32)).astype(np.float32).tolist()
    rows = [(1, near[0]), (None, near[1]), (2, near[2]), (None, far[0]), (None, far[0]), (7, far[1]), (-5, far[1])]
    kind = "vec_id long, embedding array<float>, rep long, least long, weight long, component long, name string, u long"
    frame = spark.createDataFrame([(i, v, 9, 9, 9, 9, "n", 9) for i, v in rows], kind)
    got = sorted(V.links(frame).collect(), key=str)
    want = [(1, 2, 1), (None, 2, 1), (2, 2, 1), (None, 1, None), (None, 1, None), (7, 1, -5), (-5, 1, -5)]
    assert sorted(((r.id, r.n_links, r.component) for r in got), key=str) == sorted(want, key=str)


def test_one_long_text_does_not_drop_its_class(spark):
    docs = spark.createDataFrame([(k, "x" * (5000 if k == 3 else 50)) for k in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int")
    got = T.sample(docs, labels, "doc_id", "text", "toxic", 10, 4000)
    assert sorted(got["id"]) == [k for k in range(12) if k != 3]
