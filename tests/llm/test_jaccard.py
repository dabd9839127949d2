from __future__ import annotations

import random

from tessera.llm import jaccard

from .brute import docs_frame, gram_set, sentence


def brute(rows, n, t):
    """Pairs of distinct sets by their least ids, and ties of equal sets to the least id."""
    sets: dict[frozenset, list[int]] = {}
    for i, text in rows:
        if i is not None and (g := frozenset(gram_set(text, n))):
            sets.setdefault(g, []).append(i)
    out = {}
    items = [(g, sorted(set(ids))) for g, ids in sets.items()]
    for k, (g, ids) in enumerate(items):
        for other in ids[1:]:
            out[(ids[0], other)] = 1.0
        for h, jds in items[k + 1 :]:
            if (s := len(g & h) / len(g | h)) >= t and ids[0] != jds[0]:
                out[tuple(sorted((ids[0], jds[0])))] = s
    return out


def found(df):
    rows = [(r["doc_a"], r["doc_b"], r["jaccard"]) for r in df.collect()]
    assert len({r[:2] for r in rows}) == len(rows)  # each pair once
    return {r[:2]: r[2] for r in rows}


def rows_of(seed, groups=25):
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(groups):
        base = sentence(rng, rng.randrange(3, 120)).split()
        for _ in range(rng.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 12)):
                words[rng.randrange(len(words))] = rng.choice("pqr") + str(rng.randrange(99))
            rows.append((k, " ".join(words)))
            k += rng.randrange(1, 4)
    return rows


def test_against_brute_force(spark):
    for seed, n, t in ((1, 3, 0.6), (2, 2, 0.8), (3, 5, 0.5)):
        rows = rows_of(seed)
        want, got = brute(rows, n, t), found(jaccard.similar_pairs(docs_frame(spark, rows), n, t))
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def brute_classes(rows, n=3, t=0.6):
    """{doc_id: (class, links)} over all pairs of documents."""
    sets = [(i, frozenset(gram_set(text, n))) for i, text in dict.fromkeys(rows) if i is not None]
    sets = [(i, g) for i, g in sets if g]
    near = {i: set() for i, _ in sets}
    for k, (i, g) in enumerate(sets):
        for j, h in sets[k + 1 :]:
            if i != j and len(g & h) / len(g | h) >= t - 1e-12:
                near[i].add(j)
                near[j].add(i)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        if near[i]:
            out[i] = (min(seen), len(near[i]))
    return out


def found_classes(df):
    rows = df.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: (r["class_id"], r["links"]) for r in rows}


def test_classes_against_brute_force_over_documents(spark):
    rng = random.Random(11)
    rows = rows_of(4, 12)
    base = sentence(rng, 40)
    rows += [(1000 + i, base if i % 8 else base + f" end{i}") for i in range(40)]  # 35 copies, 5 near ones
    want = brute_classes(rows)
    assert found_classes(jaccard.classes(docs_frame(spark, rows))) == want and want[1000][1] == 39
    kept = {r["doc_id"] for r in jaccard.one_of_each(docs_frame(spark, rows)).collect()}
    assert kept == {i for i, _ in rows} - {i for i, (c, _) in want.items() if i != c}


def test_blocks_of_a_hub(spark, monkeypatch):
    """A hub that is cut in many blocks gives the links of one that isn't."""
    rng = random.Random(5)
    base = sentence(rng, 60).split()
    rows = [(i, " ".join(w if rng.random() > 0.04 else "x%d" % rng.randrange(10**6) for w in base)) for i in range(120)] + rows_of(9, 8)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    monkeypatch.setattr(jaccard, "ROOM", 7)
    assert found_classes(jaccard.classes(docs_frame(spark, rows))) == brute_classes(rows)
    want, got = brute(rows, 3, 0.6), found(jaccard.similar_pairs(docs_frame(spark, rows)))
    assert got.keys() == want.keys()


def test_thresholds_below_a_half(spark):
    """Partners of very different lengths, whose bitmaps have different widths."""
    words = [f"w{i}" for i in range(160)]
    rows = [(1, " ".join(words[:62])), (2, " ".join(words[:147])), (3, " ".join(words[:30])), (4, " ".join(words[100:160]))]
    for t in (0.4, 0.2, 0.1):
        want, got = brute(rows, 3, t), found(jaccard.similar_pairs(docs_frame(spark, rows), 3, t))
        assert got.keys() == want.keys() and want


def test_a_large_group_meets_once(spark):
    rng = random.Random(5)
    base = sentence(rng, 60).split()
    rows = [(i, " ".join(w if rng.random() > 0.03 else "x%d" % rng.randrange(10**6) for w in base)) for i in range(150)]
    want, got = brute(rows, 3, 0.6), found(jaccard.similar_pairs(docs_frame(spark, rows)))
    assert got.keys() == want.keys()
    assert found_classes(jaccard.classes(docs_frame(spark, rows))) == brute_classes(rows)


def test_edges(spark):
    long = "w " * 70000 + "end"
    rows = [(1, None), (2, ""), (3, "..."), (4, "one"), (5, "One!"), (5, "One!"), (None, "one"), (6, long), (7, long), (8, "a b c d"), (9, "A b, c d"), (10, " ".join(f"q{i}" for i in range(70000))), (11, " ".join(f"q{i}" for i in range(1, 70000)))]
    assert found(jaccard.similar_pairs(docs_frame(spark, rows, extra=True))).keys() == {(4, 5), (6, 7), (8, 9), (10, 11)}
    kept = jaccard.one_of_each(docs_frame(spark, rows, extra=True))
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 8, 10]
    assert found_classes(jaccard.classes(docs_frame(spark, rows, extra=True))) == {4: (4, 1), 5: (4, 1), 6: (6, 1), 7: (6, 1), 8: (8, 1), 9: (8, 1), 10: (10, 1), 11: (10, 1)}
    assert jaccard.similar_pairs(docs_frame(spark, [])).count() == 0 and jaccard.classes(docs_frame(spark, [])).count() == 0
    assert jaccard.one_of_each(docs_frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 80), (200, 201)] + [(rng.randrange(300, 330), rng.randrange(300, 330)) for _ in range(40)]
    import collections

    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        if min(seen) != x:
            want[x] = min(seen)
    got = jaccard.components(spark.createDataFrame(edges, "doc_a long, doc_b long"))
    assert {r["id"]: r["root"] for r in got.collect()} == want
