"""rounds of matching points are slabs of the order, however long contacts wait for each other."""

import math

import numpy as np
import pytest

from strandmill.operators import contacts as K

ATOMS = "family string, site long, x double, y double, z double"


def plain(rows, cutoff, distance):
    """One scan of all contacts, by i and then by j, of rows (site, point)."""
    near = {(a, b) for a, p in rows for b, q in rows if b - a >= distance and math.sqrt(sum((x - y) * (x - y) for x, y in zip(p, q, strict=True))) < cutoff}
    used, out = set(), []
    for i, j in sorted(near):
        if not {i, j} & used:
            used |= {i, j}
            out.append((i, j))
    return out


def test_rounds_do_not_grow_with_what_waits(spark):
    """600 points of one clump, where each contact waits for others far back: took a round for every few of them."""
    rng = np.random.default_rng(5)
    rows = [(n, tuple(map(float, p))) for n, p in enumerate(rng.normal(0, 0.125, (600, 3)))]
    atoms = spark.createDataFrame([("f", n, *p) for n, p in rows], ATOMS)
    spark.sparkContext.setJobGroup("matching", "jobs of a matching")
    try:
        found = K.matching_of_points(atoms, 0.1, 7, whole=8).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("matching"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r.i, r.j) for r in found) == plain(rows, 0.1, 7)
    assert jobs < 30, jobs


@pytest.mark.parametrize("slab", [6, 1 << 16])
def test_slabs_take_what_one_scan_takes(spark, monkeypatch, slab):
    """Free sites of earlier slabs near and far, sites at several points, points on the edges of cells and far away; no contacts are made."""
    monkeypatch.setattr(K, "distance_contacts", None)
    monkeypatch.setattr(K, "SLAB_SITES", slab)
    rng = np.random.default_rng(7)
    families = {
        "several": [(int(n), p) for n, p in zip(rng.integers(-9, 25, 40), rng.normal(0, 0.3, (40, 3)))],
        "edges": [(3 * n, np.round(p, 1)) for n, p in enumerate(rng.uniform(-0.3, 0.3, (40, 3)))],
        "wide": [(n, p) for n, p in enumerate(rng.uniform(-0.8, 0.8, (40, 3)))],
        "far": [(n, (1e300 * (n % 3 - 1), 1e12, 0.05 * (n % 2))) for n in range(30)],
    }
    families = {f: [(n, tuple(map(float, p))) for n, p in rows] for f, rows in families.items()}
    nothing = [("far", 50, float("inf"), 0.0, 0.0), ("far", 60, float("inf"), 0.0, 0.0), ("far", 70, float("nan"), 0.0, 0.0), ("far", None, 0.0, 0.0, 0.0)]
    atoms = spark.createDataFrame([(f, n, *p) for f, rows in families.items() for n, p in rows] + nothing, ATOMS)
    want = sorted((f, i, j) for f, rows in families.items() for i, j in plain(rows, 0.1, 7))
    assert len({f for f, _, _ in want}) >= 3
    assert sorted(map(tuple, K.matching_of_points(atoms, 0.1, 7, whole=8).collect())) == want
    if slab == 6:
        assert sorted(map(tuple, K.matching_of_points(atoms, 0.1, 7).collect())) == want
