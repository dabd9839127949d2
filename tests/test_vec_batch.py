"""Batch search for every row against brute force."""

from __future__ import annotations

import numpy as np

from tessera import catalogue
from tessera.operators import vectors


def test_every_row_has_its_neighbours(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 16)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(vectors, "BLOCK", 60)  # several blocks
    monkeypatch.setattr(vectors, "_SCORES", 500)
    got = {(r["query_id"], r["id"]) for r in catalogue.QUERIES["vec_batch_all"](spark, str(tmp_path)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {(i, int(j)) for i, row in enumerate(-u @ u.T) for j in np.argsort(row)[:5]}


def test_memory_does_not_grow_with_the_queries():
    """What a task has while many queries meet the rows of a batch: 50 MB at most; and runs of any length find the same."""
    import tracemalloc

    rng = np.random.default_rng(4)
    q, x = rng.normal(size=(40_000, 8)), rng.normal(size=(300, 8))
    who = np.arange(0, len(q), 2)
    tracemalloc.start()
    n = sum(len(some) for some, _, _ in vectors._nearest(q, who, x, 5, "cosine", vectors._SCORES))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(who) and peak < 50e6
    for metric in ("dot", "l2"):
        s = -(q[who[:50]] @ x.T) if metric == "dot" else ((q[who[:50], None] - x[None]) ** 2).sum(2)
        for most in (1, 700, 10**6):
            got = [(i, set(t.tolist()), sorted(v)) for some, top, score in vectors._nearest(q, who[:50], x, 5, metric, most) for i, t, v in zip(some.tolist(), top, score, strict=True)]
            assert [g[0] for g in got] == who[:50].tolist() and [g[1] for g in got] == [set(r.tolist()) for r in np.argsort(s)[:, :5]]
            assert np.allclose([g[2] for g in got], -np.sort(s)[:, 4::-1])
