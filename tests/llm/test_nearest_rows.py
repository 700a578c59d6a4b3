"""Nearest neighbours in tables that repeat rows and ids."""

import numpy as np

from tidemark.llm import ann


def test_nearest_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    hot = [(999, (vectors[20] * 3 + rng.normal(size=8) * 0.01).tolist()) for _ in range(400)]
    ids = np.array([r[0] for r in rows + hot])
    every = np.array([r[1] for r in rows + hot])
    for extra in ([], hot):
        table = spark.createDataFrame(rows + rows + extra, "vec_id long, embedding array<double>")
        got = {}
        for r in ann.nearest(table, table.filter("vec_id % 20 = 0")).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        held = slice(0, len(rows) + len(extra))
        for q in range(0, 300, 20):
            best = {}
            for i, s in zip(ids[held].tolist(), (every[held] * vectors[q]).sum(1).tolist()):
                if i != q:
                    best[i] = max(s, best.get(i, s))
            assert [i for _, i in sorted(got[q])] == sorted(best, key=lambda i: (-best[i], i))[:20]
