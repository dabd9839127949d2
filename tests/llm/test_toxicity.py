from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from tessera.llm import toxicity as tx
from tessera.llm.common import table

from .brute import docs_frame, sentence, word_hashes


def sparse(x):
    q, t = np.nonzero(x)
    return q, t, x[q, t].astype(np.float32)


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    x = np.where(rng.random((1500, 400)) < 0.4 / (1 + np.arange(400) / 4), rng.random((1500, 400)), 0).astype(np.float32)
    x[:, 40:] *= 6  # rare terms are heavy
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    x[700:720] = x[700]  # ties
    labels, ids = (rng.random(1500) < 0.4).astype(float), rng.permutation(5000)[:1500]
    index = tx.Index(*sparse(x), 400, labels, ids, np.arange(1500) // 2)
    assert 0 < len(index.most) < 400
    q = x[600:800]
    full = q @ x.T
    for own in (None, np.arange(600, 800) // 2):
        index.scored = 0
        who, sims = index.nearest(*sparse(q), 200, 15, own)
        assert index.scored < 200 * index.blocks  # some blocks are passed over
        for i in range(200):
            left = [j for j in range(1500) if own is None or j // 2 != own[i]]
            order = sorted(left, key=lambda j: (-round(float(full[i, j]), 6), ids[j]))[:15]
            got = [(int(index.ids[e]), round(float(s), 4)) for e, s in zip(who[i], sims[i], strict=True) if e >= 0]
            want = [(int(ids[j]), round(float(full[i, j]), 4)) for j in order if full[i, j] > 1e-6]
            assert [s for _, s in got] == [s for _, s in want]
            assert sum(a == b for a, b in zip(got, want, strict=True)) >= len(want) - 1


def test_the_query_against_a_brute_force_version(spark, tmp_path):
    """Draw, frequencies, cosines over all words, chi squared, votes and evidence in plain Python, but for the curve, which is the model's."""
    rng = random.Random(4)
    rows = [(i, " ".join([sentence(rng, rng.randrange(5, 40))] + ["vile nasty filth"[: 5 * (1 + i % 3)]] * (i % 4 == 0))) for i in range(120)]
    labels = [(i, int(i % 4 == 0)) for i in range(60)]
    docs_frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    label_frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    label_frame.write.parquet(str(tmp_path / "labels.parquet"))
    tokens = {i: Counter(word_hashes(t)) for i, t in rows}
    df = Counter(w for c in tokens.values() for w in c)
    known = set()
    for w in {w for i, _ in labels for w in tokens[i]}:
        a, b = (sum(w in tokens[i] for i, y in labels if y == k) for k in (1, 0))
        c, d = 15 - a, 45 - b
        if a + b >= tx.LEAST_EXAMPLES and 60 * (a * d - b * c) ** 2 / max(1e-9, (a + b) * (c + d) * (a + c) * (b + d)) >= tx.CHI_SQUARED:
            known.add(w)
    assert len(known) >= 2

    def vector(c):
        x = {w: (1 + math.log(n)) * max(0.05, math.log(121 / (df[w] + 0.5))) for w, n in c.items() if w in known}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {w: v / size for w, v in x.items()}

    examples = {i: vector(tokens[i]) for i, _ in labels}
    model = tx.train(docs_frame(spark, rows), label_frame)
    got = {r["doc_id"]: r for r in tx.query(spark, str(tmp_path)).collect()}
    assert len(got) == 120
    for i, _ in rows:
        v = vector(tokens[i])
        near = sorted(((round(sum(x * e.get(w, 0) for w, x in v.items()), 6), j) for j, e in examples.items()), key=lambda p: (-p[0], p[1]))[: tx.K]
        near = [(s, j) for s, j in near if s > 1e-9]
        vote = sum(s for s, j in near if j % 4 == 0) / (sum(s for s, _ in near) + tx.SMOOTH)
        score = 1 / (1 + math.exp(-(model.curve[0] * vote + model.curve[1])))
        assert abs(got[i]["score"] - score) < 1e-3 and got[i]["evidence"] == [j for _, j in near[: tx.EVIDENCE]]
        assert np.allclose(got[i]["similar"], [s for s, _ in near[: tx.EVIDENCE]], atol=1e-4)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    train, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    model = tx.train(docs, train)
    rated = tx.rate(docs, model).select("doc_id", "score", tx.F.col("toxic").alias("found"))
    got = held.join(rated, "doc_id").select("toxic", "found", "score").collect()
    bad, clean = [r for r in got if r["toxic"]], [r for r in got if not r["toxic"]]
    assert sum(r["found"] for r in bad) >= 0.8 * len(bad)
    assert sum(r["found"] for r in clean) <= 0.02 * len(clean)
    brier = np.mean([(r["score"] - r["toxic"]) ** 2 for r in got])
    assert brier < 0.04


def test_edges(spark):
    rows = [(i, f"word{i} plain text here" + (" nasty vile" if i % 3 == 0 else "")) for i in range(60)] + [(100, None), (101, ""), (None, "vile nasty"), (102, "vile " * 60000), (7, "word7 plain text here")]
    docs = docs_frame(spark, rows, extra=True)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    model = tx.train(docs, labels)
    got = [(r["doc_id"], r["toxic"], len(r["evidence"])) for r in tx.rate(docs, model).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g[1:] for g in got}
    assert by[None][0] and by[102][0] and not by[100][0] and by[101] == (False, 0) and sum(g[0] == 7 for g in got) == 2
    assert all(by[i][0] == (i % 3 == 0) for i in range(60))
    one = tx.train(docs, labels.where("toxic = 0"))
    assert not any(r["toxic"] for r in tx.rate(docs, one).collect())
    assert tx.rate(docs_frame(spark, []), tx.train(docs_frame(spark, []), labels)).count() == 0
