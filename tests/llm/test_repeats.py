from __future__ import annotations

import random
from collections import Counter

from tessera.llm import repeats

from .brute import docs_frame, sentence, word_hashes


def brute(rows, length):
    """(doc_id, start, length, later) by looking at every stretch of `length` words."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t}, key=lambda r: r[0])
    windows = [[tuple(h[j : j + length]) for j in range(len(h) - length + 1)] for h in (word_hashes(t) for _, t in docs)]
    count, seen, out = Counter(x for w in windows for x in w), {}, []
    for (i, _), w in zip(docs, windows, strict=True):
        here, late = set(), set()
        runs = []
        for j, x in enumerate(w):
            if count[x] > 1:
                here |= set(range(j, j + length))
                if runs and j <= runs[-1][1]:
                    runs[-1][1] = j + length
                else:
                    runs.append([j, j + length])
            if x in seen and (seen[x][0] != i or j - seen[x][1] >= length):
                late |= set(range(j, j + length))
            seen.setdefault(x, (i, j))
        out += [(i, a, b - a, len(late & set(range(a, b)))) for a, b in runs]
    return sorted(out)


def rows_of(seed, docs=40):
    rng = random.Random(seed)
    shared = [sentence(rng, n) for n in (12, 15, 30, 50, 80)]
    rows = []
    for i in range(docs):
        parts = [sentence(rng, rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            words = rng.choice(shared).split()
            lo = rng.randrange(0, max(1, len(words) // 2))
            parts += [" ".join(words[lo:]), sentence(rng, rng.randrange(0, 10))]
        rows.append((i * 2, " ".join(parts)))
    return rows


def found(df):
    return sorted((r["doc_id"], r["start"], r["length"], r["later"]) for r in df.collect())


def test_against_brute_force(spark):
    for seed, length, k in ((1, 12, 5), (2, 20, 8), (3, 50, 20), (4, 6, 6)):
        rows = rows_of(seed)
        assert found(repeats.maximal_repeats(docs_frame(spark, rows), length, k)) == brute(rows, length)


def test_edges(spark):
    rng = random.Random(8)
    p = sentence(rng, 60)
    rows = [(1, None), (2, ""), (3, p), (3, p), (None, p), (4, "a b c"), (5, p + " end"), (6, "same " * 200), (7, " ".join(sentence(rng, 30000).split()) + " " + p)]
    frame = docs_frame(spark, rows, extra=True)
    assert found(repeats.maximal_repeats(frame)) == brute(rows, 50)
    kept = {r["doc_id"]: r for r in repeats.without_repeats(frame).collect()}
    assert set(kept) == {None, 1, 2, 3, 4, 5, 6, 7}
    assert kept[5]["text"] == "end" and kept[5]["n_chars"] == 3 and kept[None]["text"] == kept[3]["text"] == p
    assert len(kept[6]["text"].split()) == 50 and kept[1]["text"] is None
    assert repeats.maximal_repeats(docs_frame(spark, [])).count() == 0 and repeats.without_repeats(docs_frame(spark, [])).count() == 0


def test_hot_seeds_and_full_tables(spark, monkeypatch):
    """Seeds beyond HOT go by fingerprints of their stretches, and a table of names that is full lets all through: the repeats are the same."""
    rng = random.Random(21)
    p = sentence(rng, 70)
    rows = rows_of(5) + [(100 + i, f"{sentence(rng, 12)} {p} {sentence(rng, 9)}") for i in range(30)] + [(140, p), (140, p)]
    want = brute(rows, 30)
    assert found(repeats.maximal_repeats(docs_frame(spark, rows), 30, 10)) == want
    monkeypatch.setattr(repeats, "BITS_MOST", 17)
    monkeypatch.setattr(repeats, "HOT", 20)
    assert found(repeats.maximal_repeats(docs_frame(spark, rows), 30, 10)) == want
    monkeypatch.setattr(repeats, "HOT", 1)
    assert found(repeats.maximal_repeats(docs_frame(spark, rows), 30, 10)) == want


def test_copies_are_sent_once():
    """What a mapper sends of a text and its copies is little more than the text: words go once."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm import suffixes, textscan

    text = sentence(random.Random(22), 3000)

    def sent(n, seeds):
        (_, _, w), *_ = textscan.words(pa.array([text] * n))
        found = seeds(w)
        got = repeats.contexts(w, found, found[0].astype("i8"), found[0].astype("i8"), 50)
        return sum(len(b) for r in repeats.sent_once([[c] for c in got], 4, 50) for b in r.column(1).to_pylist()), len(np.unique(found[3]))

    for seeds in (lambda w: suffixes.phrase_seeds(w, 50, 4, 16), lambda w: repeats.anchor_seeds(w, 50, 20)):
        (one, names), (many, again) = sent(1, seeds), sent(30, seeds)
        assert names == again and many < 5 * one


def test_cut_keeps_the_first_occurrence(spark):
    rows = rows_of(11)
    out = {r["doc_id"]: r["text"] for r in repeats.without_repeats(docs_frame(spark, rows), 12, 5).collect()}
    before = {x for _, t in rows for h in [word_hashes(t)] for x in (tuple(h[j : j + 12]) for j in range(len(h) - 11))}
    late = {i: n for i, _, _, n in brute(rows, 12) if n}
    for i, t in rows:
        assert (i not in late) == (out.get(i) == t)
    after = Counter(x for t in out.values() for h in [word_hashes(t)] for x in (tuple(h[j : j + 12]) for j in range(len(h) - 11)) if x in before)
    assert not after or max(after.values()) == 1
