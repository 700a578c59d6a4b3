"""Near duplicates by exact similarity of the shingle sets."""

import random

import numpy as np
import pytest

from tidemark.llm import simhash

DOCS = "doc_id long, text string"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(range(len(texts)) if ids is None else ids, texts)), DOCS)


def test_near_dedup_follows_the_exact_similarity(spark):
    """Pairs of texts at 0.8 to 0.95 lose the later one, pairs at 0.6 to 0.79 lose none."""
    rng = random.Random(12)
    rows, want, at = [], set(), 0
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    seen = {True: 0, False: 0}
    while min(seen.values()) < 60:
        base = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice((9, 30, 120, 400)))]
        other = list(base)
        for _ in range(rng.randrange(1, 1 + max(1, len(base) // 15))):
            other[rng.randrange(len(other))] = f"v{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            other = base[: -rng.randrange(1, 1 + len(base) // 4)]
        a, b = shingles(base), shingles(other)
        near = len(a & b) / len(a | b)
        if not 0.6 <= near <= 0.95 or seen[near >= 0.8] >= 60:
            continue
        seen[near >= 0.8] += 1
        rows += [" ".join(base), " ".join(other)]
        want |= {at} if near >= 0.8 else {at, at + 1}
        at += 2
    got = {r.doc_id for r in simhash.near_dedup(docs_of(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_dedup_of_a_group_keeps_what_no_kept_one_covers(spark, rounds):
    """Every dropped label is similar to a kept one before it, no kept one is; by join and by task alike."""
    rng = random.Random(3)
    held = [sorted(rng.sample(range(60), rng.randrange(40, 60))) for _ in range(80)]
    near = lambda a, b: len({*a} & {*b}) >= 0.8 * len({*a} | {*b})
    kept = []
    for i, h in enumerate(held):
        if not any(near(h, held[k]) for k in kept):
            kept.append(i)
    sets = spark.createDataFrame([(1, i, 1000 - i, h) for i, h in enumerate(held)], "root long, doc long, label long, held array<long>")
    gone = [r.label for r in simhash.similar_labels(sets, 0.8, rounds).collect()]
    assert sorted(gone) == sorted(1000 - i for i in range(80) if i not in kept)


def test_near_dedup_keeps_a_repeated_id_with_a_text_that_stays(spark):
    docs = docs_of(spark, ["a b c d e f g h", "m n o p q r s t", "a b c d e f g h", "m n o p q r s t"], [3, 5, 5, 7])
    assert sorted(r.doc_id for r in simhash.near_dedup(docs).collect()) == [3, 5, 5]


def test_only_sizes_within_the_similarity_are_compared():
    """Every pair of sizes within the ratio lies in the windows, and few others do."""
    sizes = np.sort(np.concatenate([np.arange(1, 200), np.random.default_rng(4).integers(1, 20_000, 600)]))
    begins, ends = simhash.size_windows(sizes, sizes, 0.8)
    inside = (np.arange(len(sizes)) >= begins[:, None]) & (np.arange(len(sizes)) < ends[:, None])
    ratio = np.minimum(sizes, sizes[:, None]) * 10 >= 8 * np.maximum(sizes, sizes[:, None])
    assert (inside == ratio).all()


def test_bands_of_sizes_lose_no_similar_pair(spark):
    """Equal fingerprints link where the sizes allow the similarity, whatever tile or band they are in."""
    rows = [([7, 7, 7, 7], n, n) for n in (1, 4, 5, 6, 100, 125, 160, 1000, 1251)]
    prints = spark.createDataFrame(rows, "fp array<long>, node long, size long")
    for tile in (1, 100):
        got = {(r.node, r.root) for r in simhash.near_groups(prints, 256, 73, tile, half=41, similarity=0.8).collect()}
        assert got == {(4, 4), (5, 4), (6, 4), (100, 100), (125, 100)}
