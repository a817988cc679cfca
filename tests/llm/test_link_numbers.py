"""How many links a search gives for one large group."""

import numpy as np

from strandmill.llm import simhash
from strandmill.llm._shared import connected_components


def test_links_of_a_large_group_grow_with_its_rows(spark):
    """Fingerprints around one, far more than a bucket holds: whatever the parts and views, a few links a row."""
    rng = np.random.default_rng(5)
    near = set()
    while len(near) < 1500:  # up to two bits away: all within four of each other, all within three of many
        near.add(int(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, 2).astype(np.uint64))))
    far = [int(x) for x in rng.integers(0, 2**63, 200)]
    rows = [(k, fp.to_bytes(8, "little")) for k, fp in enumerate([*near, *far])]
    frame = spark.createDataFrame(rows, "rep long, fp binary")
    for bucket in (100, 4096):
        found = simhash.links(frame, bucket=bucket)
        assert found.count() <= 10 * len(near)
        assert {r.node: r.component for r in connected_components(found).collect() if r.node < len(near)} == dict.fromkeys(range(len(near)), 0)
