from __future__ import annotations

import random

from tessera.llm import suffixes

from .brute import docs_frame, sentence
from .test_repeats import brute, found, rows_of


def test_against_brute_force(spark):
    for seed, length, trigger, modulus in ((1, 12, 2, 3), (2, 20, 4, 8), (3, 50, 4, 8), (4, 8, 1, 2), (5, 15, 3, 40)):
        rows = rows_of(seed)
        assert found(suffixes.repeated_passages(docs_frame(spark, rows), length, trigger, modulus)) == brute(rows, length)


def test_corpus_order_against_a_suffix_sort(monkeypatch):
    """All suffixes of a small corpus in corpus order, with their common prefixes, against sorting them word by word."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm import common, repeats, textscan

    length, trigger, modulus = 30, 2, 4
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        base = sentence(rng, 200).split()
        texts = [" ".join(w if rng.random() > 0.02 else "x%d" % rng.randrange(999) for w in base[rng.randrange(40) :]) for _ in range(9)]
        (_, _, w), *_ = textscan.words(pa.array(texts))
        d, begin, at, name, n = suffixes.phrase_seeds(w, length, trigger, modulus)
        short = (w.hash >> np.uint64(32)).astype("u4")
        counts = n - 1 + length
        owner, k = textscan.expand(counts)
        of = np.arange(len(d)).astype("u4")
        blob = common.packed(name, d.astype("i8"), d.astype("i8"), (at - w.first[d]).astype("u4"), of) + common.packed((at - begin).astype("u1"), n.astype("u1")) + common.packed(short[begin[owner] + k])
        o = repeats.Occurrences(iter([blob]), length)
        s = suffixes.CorpusOrder(o, length, trigger)

        def suffix(i):
            start = w.first[o.doc[s.of[i]]] + o.pos[s.of[i]] - s.tail[i]
            return tuple(short[start : start + length].tolist())

        got = [suffix(i) for i in range(len(s.of))]
        assert got == sorted(got) and len(got) > 300
        for i in range(1, len(got)):
            want = next((j for j in range(length) if got[i][j] != got[i - 1][j]), length)
            assert s.common[i] == want or (s.common[i] == 0 and want < length)


def test_hot_phrases(spark, monkeypatch):
    from tessera.llm import repeats

    rows = rows_of(6)
    want = brute(rows, 20)
    monkeypatch.setattr(repeats, "HOT", 2)
    assert found(suffixes.repeated_passages(docs_frame(spark, rows), 20, 4, 8)) == want


def test_edges(spark):
    rng = random.Random(8)
    p = sentence(rng, 60)
    rows = [(1, None), (2, ""), (3, p), (3, p), (None, p), (4, "a b c"), (5, p + " end"), (6, "same " * 200), (7, sentence(rng, 30000) + " " + p), (8, "a b " * 90)]
    assert found(suffixes.repeated_passages(docs_frame(spark, rows, extra=True))) == brute(rows, 50)
    assert suffixes.repeated_passages(docs_frame(spark, [])).count() == 0
