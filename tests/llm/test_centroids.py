"""Clustering against a plain reading of its rule."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import centroids

ROWS = "vec_id long, embedding array<float>, label int, block long, place int, cluster int, parts string"


def table_of(spark, rows):
    """An embeddings table whose extra columns clash with the operator's own names."""
    return spark.createDataFrame([(i, v, 1, 5, 6, 7, "x") for i, v in rows], ROWS)


def plain(rows, clusters, rounds, size, scale=256, seed=2):
    kept = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
        if i is not None and v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r))
    now = [v for _, v in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(now)) for _, v in kept]

    for _ in range(rounds):
        home = assign()
        for k in range(len(now)):
            mine = [v for (_, v), (_, c) in zip(kept, home) if c == k]
            if mine:
                now[k] = [sum(col) // len(mine) for col in zip(*mine)]
    home = assign()
    return sorted(
        (i, c, d, sum(e for e, o in home if o == c), sum(e for e, _ in home), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest())
        for (i, _), (d, c) in zip(kept, home)
    )


def ours(table, **how):
    found = centroids.with_inertia(*centroids.cluster_vectors(table, **how))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(tuple(r) for r in found.collect())


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(5)
    middles = [[rng.uniform(-3, 3) for _ in range(4)] for _ in range(6)]
    return [(k, [m + rng.gauss(0, 0.3) for m in rng.choice(middles)]) for k in range(400)]


@pytest.mark.parametrize("clusters", [1, 2, 7, 40])
def test_equals_plain_reading(spark, vectors, clusters):
    assert ours(table_of(spark, vectors).repartition(3), clusters=clusters, size=4) == plain(vectors, clusters, 5, 4)


def test_awkward_rows(spark, vectors):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0] * 4), (1000, None), (1001, []), (1002, [1.0] * 3), (1003, [1.0] * 5), (1004, [1.0, None, 1.0, 1.0]), (1005, [nan, 0.0, 0.0, 0.0]),
           (1006, [inf, 0.0, 0.0, 0.0]), (1007, [0.0] * 4), (1008, [0.0] * 4), (3, [9.0] * 4), *vectors[:30], *[(5, [0.5] * 4)] * 300]
    rows = vectors + odd
    assert ours(table_of(spark, rows), clusters=9, size=4) == plain(rows, 9, 5, 4)


def test_ties_and_large_components(spark):
    grid = [(k, [float(k % 5), float(k // 5 % 5)]) for k in range(50)]
    assert ours(table_of(spark, grid), clusters=8, size=2) == plain(grid, 8, 5, 2)
    wide = [(k, [float((-1) ** k * 400_000 + k), float(k)]) for k in range(60)]
    assert ours(table_of(spark, wide), clusters=5, size=2) == plain(wide, 5, 5, 2)
    assert [r[0] for r in ours(table_of(spark, [*grid, (99, [1e30, 0.0])]), clusters=8, size=2)] == [i for i, _ in grid]


def test_few_and_no_vectors(spark):
    two = [(1, [0.0, 1.0]), (2, [3.0, 4.0])]
    assert ours(table_of(spark, two), clusters=40, size=2) == plain(two, 40, 5, 2)
    assert ours(table_of(spark, []), size=2) == []


def test_bounds_hold_and_spare_work(vectors):
    """Heaps carried through drifting centroids assign as a full scan does, and measure less than all."""
    rng = np.random.default_rng(1)
    points = np.array([[math.floor(256 * x) for x in v] for _, v in vectors], np.int64)
    now = points[:6].copy()
    block = centroids.Block.__new__(centroids.Block)
    block.parts, block.vec_id = points, np.arange(len(points))
    block.heaps, block.total = [[] for _ in now], np.zeros((6, 4), np.int64)
    drift, measured, scan = np.zeros(6), [], centroids.rescan
    try:
        centroids.rescan = lambda v, c: (measured.append(len(v)), scan(v, c))[1]
        for n in range(12):
            block.settle(now, drift, n == 0)
            home = block.assigned(now).column("cluster").to_numpy()
            assert (home == centroids.square_distances(points, now).argmin(1)).all()
            assert all((block.total[c] == points[home == c].sum(0)).all() for c in range(6))
            moved = now + rng.integers(-9, 9, now.shape) // (n + 1)
            drift = drift + centroids.drifts(now.tolist(), moved.tolist())
            now = moved
    finally:
        centroids.rescan = scan
    assert measured[0] == len(points) and max(measured[1:]) < len(points)


def test_rounds_do_not_move_vectors(spark, vectors):
    blocks = centroids.Blocks(spark, centroids.integer_vectors(table_of(spark, vectors), 4, 256))
    heaps = blocks.write(spark.createDataFrame([(0, 0, [1.0], [0], [1, 1, 1, 1])], centroids.HEAPS), "heaps")
    both = blocks.vectors.groupBy("block").cogroup(heaps.groupBy("block")).applyInArrow(lambda a, b: a.select(["block"]), "block long")
    plan = both._jdf.queryExecution().executedPlan().toString()
    blocks.release()
    spark.sql(f"DROP TABLE {blocks.tables[0]}")
    assert "FlatMapCoGroupsInArrow" in plan and "Exchange" not in plan
