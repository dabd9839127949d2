from __future__ import annotations

import random

import corpus_pipeline

from .brute import docs_frame, sentence
from .test_decontaminate import brute as brute_leaks
from .test_jaccard import brute as brute_pairs
from .test_repeats import brute as brute_repeats


def corpus():
    rng = random.Random(4)
    items = [(k, sentence(rng, 40) + ". " + sentence(rng, 6)) for k in range(4)]
    passage = sentence(rng, 60)
    rows = []
    for i in range(80):
        body = ". ".join(sentence(rng, 12) for _ in range(8)) + "."
        if i % 10 == 1:
            body += " " + passage
        if i % 10 == 2:
            body += " " + items[i % 4][1]
        rows.append((i, body))
    rows += [(100 + i, rows[i][1] + " tail") for i in range(0, 80, 7)]
    rows += [(200 + i, " ".join(w + rng.choice(["$$$", "%%%", "###"]) for w in sentence(rng, 90).split())) for i in range(12)]
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs_frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    def after(name, frame):
        out = stages[name](spark, frame, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        return out

    good = after("quality", docs)
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert not any(i >= 200 for i in kept) and len(kept) >= 0.95 * (len(rows) - 12)

    single = after("near_duplicates", good)
    pairs = brute_pairs(list(kept.items()), 3, 0.6)
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    assert set(left) == set(kept) - {b for _, b in pairs}  # here every group is a pair, or hangs on its least document

    unique = after("repeats", single)
    cut = {r["doc_id"]: r["text"] for r in unique.collect()}
    late = {i for i, _, _, n in brute_repeats(sorted(left.items()), 50) if n}
    assert {i for i in left if cut.get(i) != left[i]} == late and late

    clean = after("decontamination", unique)
    safe = {r["doc_id"] for r in clean.collect()}
    assert safe == set(cut) - {i for i, _ in brute_leaks(sorted(cut.items()), items)} and safe != set(cut)

    packed = after("packing", clean).collect()
    texts: dict[int, str] = {}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["piece"])):
        texts[r["doc_id"]] = texts.get(r["doc_id"], "") + r["text"]
    assert texts == {i: cut[i] for i in safe}

    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, packed))


def test_empty(spark, tmp_path):
    docs_frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    frame = docs_frame(spark, [(1, None), (2, ""), (None, "a b"), (None, None)], extra=True).selectExpr("*", "'kept' as __key", "'too' as __id", "1 as __later", "2 as class_id", "'a.b' as `dotted.name`")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, frame, str(tmp_path))
        assert (got.columns == frame.columns) == (name != "packing")
        rows = got.collect()
        assert len(rows) <= 4 and (name == "packing" or all((r["__key"], r["__id"], r["__later"], r["class_id"]) == ("kept", "too", 1, 2) for r in rows))
