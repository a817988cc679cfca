"""Near-duplicates by exact similarity against all pairs compared plainly."""

import itertools

import numpy as np
import pytest

from strandmill.llm import shingle_sets, simhash

SCHEMA = "doc_id long, text string"


def plain_set(text):
    words = (text or "").split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_components(texts, similarity=0.8):
    sets, least = [plain_set(t) for t in texts], list(range(len(texts)))
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(sets[a], sets[b]) >= similarity]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            m = min(least[a], least[b])
            changed |= (least[a], least[b]) != (m, m)
            least[a] = least[b] = m
    return least


def changed_copy(rng, words, n):
    own = list(words)
    for k in range(n):
        own[int(rng.integers(0, len(own)))] = f"c{rng.integers(10**9)}"
    return own


def found(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    got = {r.id: r.component for r in shingle_sets.similar_texts(docs, **how).collect()}
    return [got[k] for k in range(len(texts))]


def test_lone_pairs_about_the_similarity(spark):
    """Groups of two from below 0.8 to 0.9: all at 0.8 or more are found, none below."""
    rng = np.random.default_rng(3)
    texts = [None, "", "one two", "one two", "a b c d e f g h", "a b c d e f g h i"]  # the last two: 4 of 5
    for k in range(150):
        words = [f"q{x}" for x in rng.integers(0, 5000, int(rng.integers(40, 300)))]
        texts += [" ".join(words), " ".join(changed_copy(rng, words, max(1, len(words) // (38 if k % 2 else 50))))]
    alike = [jaccard(plain_set(a), plain_set(b)) for a, b in zip(texts[6::2], texts[7::2], strict=True)]
    assert sum(0.8 <= x < 0.85 for x in alike) >= 20 and sum(0.7 <= x < 0.8 for x in alike) >= 20
    want = plain_components(texts)
    assert found(spark, texts) == want
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == [k for k, m in enumerate(want) if k == m]


@pytest.mark.parametrize("block", [1024, 16])
def test_large_groups(spark, block):
    """Bands of many nodes: copies of one text, some linked to one another only by a third."""
    rng = np.random.default_rng(4)
    words = [f"q{x}" for x in rng.integers(0, 5000, 120)]
    texts = [" ".join(changed_copy(rng, words, int(n))) for n in rng.integers(1, 7, 200)]
    want = plain_components(texts)
    assert 5 < len(set(want)) < 190
    assert found(spark, texts, block=block) == want
