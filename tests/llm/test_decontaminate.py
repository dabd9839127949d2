from __future__ import annotations

import random

import numpy as np

from tessera.llm import decontaminate as dc

from .brute import docs_frame, sentence, word_hashes


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            old = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = old
    return row[-1]


def brute(rows, items, step=dc.STEP):
    """Every document and item with enough of the item's words in order, in any stretch of twice its length."""
    out = set()
    for i, text in rows:
        h = word_hashes(text)
        for k, t in items:
            w = word_hashes(t)
            span = 2 * len(w) + dc.WIDTH
            for j in range(0, max(1, len(h) - span + step), step):
                here = h[j : j + span]
                c = common(w, here) / len(w)
                a = dc.Benchmark.answer_of(t)
                a = a if len(a) >= 3 else w[-max(3, len(w) // 4) :]
                if c >= dc.COVERAGE or c >= dc.PARAPHRASE and common(a, here) / len(a) >= dc.ANSWER:
                    out.add((i, k))
                    break
    return out


def case(seed):
    rng = random.Random(seed)
    items = [(k, sentence(rng, rng.randrange(18, 60)) + ". " + sentence(rng, 6)) for k in range(12)]
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(0, 200))]
        if i % 4 == 0:
            words = rng.choice(items)[1].split()
            if i % 8 == 0:  # a paraphrase: some words are others, some are left out
                words = [w if rng.random() > 0.12 else "other%d" % rng.randrange(99) for w in words if rng.random() > 0.05]
            parts += [" ".join(words), sentence(rng, rng.randrange(0, 80))]
        rows.append((i, " ".join(parts)))
    return rows, items


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows, items = case(seed)
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs_frame(spark, rows), bench).collect()}
        want = brute(rows, items)
        assert len(want) >= 13 and len(got & want) >= 0.9 * len(want)
        assert not {i for i, _ in got} - {i for i, _ in want}
        kept = {r["doc_id"] for r in dc.without_leaks(docs_frame(spark, rows), bench).collect()}
        assert kept == {i for i, _ in rows} - {i for i, _ in got}


def test_more_items_than_the_rank(spark):
    rng = random.Random(12)
    # few words in common, as items of many subjects have
    items = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(38))) for k in range(300)]
    rows = [(i, " ".join([sentence(rng, 40), items[i][1], sentence(rng, 40)])) for i in range(100)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs_frame(spark, rows), bench, rank=32).collect()}
    assert len(got & {(i, i) for i in range(100)}) >= 90


def test_common_length():
    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert dc.common_length(np.array(a, np.uint64), np.array(b, np.uint64)) == common(a, b)


def test_latent_space_against_a_dense_svd(spark):
    """The leading singular values and vectors of passages and items, against numpy's SVD of the whole matrix."""
    rows, items = case(4)
    bench = dc.Benchmark(items)
    only = docs_frame(spark, rows).select("text")
    idf = dc.frequencies(only, bench)
    rank = 12
    v, sigma = dc.latent_space(only, bench, idf, rank)
    assert np.allclose(v.T @ v, np.eye(rank), atol=1e-4)
    cells = [h[j : j + dc.WIDTH] for _, t in rows for h in [word_hashes(t)] for j in range(0, len(h), dc.WIDTH)]

    def dense(lists):
        out = np.zeros((len(lists), bench.width))
        for i, c in enumerate(lists):
            np.add.at(out[i], bench.columns(np.array(c, np.uint64)), 1)
        out *= idf
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    m = np.concatenate((dense(cells) / np.sqrt(len(cells)), dense([w.tolist() for w in bench.words]) / np.sqrt(len(items))))
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(sigma[:6], s[:6], rtol=0.05) and (sigma <= s[:rank] * 1.0001).all()
    # what the space holds of the matrix is near the best that any of its rank can hold
    assert (np.linalg.norm(m @ v) ** 2) >= 0.93 * (s[:rank] ** 2).sum()
    # the idf of every word of the benchmark, counted in plain Python
    want = np.zeros(bench.size)
    for c in cells:
        for k in {int(x) for x in bench.columns(np.array(c, np.uint64)) if x < bench.size}:
            want[k] += 1
    assert np.allclose(idf[: bench.size], 1 + np.maximum(0, np.log((len(cells) + 1) / (want + 0.5))), atol=1e-5)


def test_an_item_that_repeats_a_word(spark):
    """A word that an item and a leak hold eight times, and the corpus else hardly."""
    rng = random.Random(5)
    rows = [(i, " ".join([f"q{i}x{rng.randrange(10**6)}" for _ in range(63)] + (["ww"] if i < 75 else []))) for i in range(200)]
    around = [" ".join(f"r{k}x{rng.randrange(10**6)}" for _ in range(36)) for k in range(2)]
    rows.append((500, f"{around[0]} {'ww ' * 8} {around[1]}"))
    bench = spark.createDataFrame([(1, "ww " * 8 + "zed")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in dc.leaks(docs_frame(spark, rows), bench).collect()] == [(500, 1)]


def test_common_words_and_blocks_of_items(spark, monkeypatch):
    """Items of words that most passages hold are found, and so they are where items are searched in blocks."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(30)]
    items = [(k, " ".join(rng.choice(common) for _ in range(40))) for k in range(9)]
    rows = [(i, " ".join(rng.choice(common) for _ in range(150))) for i in range(60)]
    rows += [(100 + k, " ".join([sentence(rng, 20), items[k][1], sentence(rng, 20)])) for k in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs_frame(spark, rows), bench).collect()}
    # of so few words some texts hold most of an item by chance, and where is a matter of the stretch that is looked at
    assert {(100 + k, k) for k in range(9)} <= got <= brute(rows, items, 1)
    monkeypatch.setattr(dc, "ITEMS", 4)
    again = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs_frame(spark, rows), bench).collect()}
    assert {(100 + k, k) for k in range(9)} <= again


def test_edges(spark):
    rng = random.Random(6)
    p = sentence(rng, 30)
    rows = [(1, None), (2, ""), (3, "??"), (4, p), (4, p), (None, p), (5, sentence(rng, 40000) + " " + p + " " + sentence(rng, 100)), (6, sentence(rng, 80))]
    bench = spark.createDataFrame([(1, p), (1, p), (2, None), (3, ""), (4, "too short"), (None, p)], "item_id long, text string").withColumnRenamed("text", "text")
    got = sorted(((r["doc_id"] or -1), r["item_id"]) for r in dc.leaks(docs_frame(spark, rows, extra=True), bench).collect())
    assert got == [(-1, 1), (4, 1), (4, 1), (5, 1)]
    assert sorted(r["doc_id"] for r in dc.without_leaks(docs_frame(spark, rows, extra=True), bench).collect()) == [1, 2, 3, 6]
    rows.append((7, "here it is: Too SHORT, indeed"))  # an item of two words
    short = sorted(((r["doc_id"] or -1), r["item_id"]) for r in dc.leaks(docs_frame(spark, rows), bench).collect())
    assert short == sorted(got + [(7, 4)])
    clash = docs_frame(spark, rows[:6]).withColumns({"text_key": dc.F.lit("keep"), "text_id": dc.F.lit("too")})
    assert {(r["text_key"], r["text_id"]) for r in dc.without_leaks(clash, bench).collect()} == {("keep", "too")}
    assert dc.leaks(docs_frame(spark, []), bench).count() == 0
    assert dc.leaks(docs_frame(spark, rows), bench.where("item_id = 9")).count() == 0
    assert dc.without_leaks(docs_frame(spark, rows), bench.where("item_id = 9")).count() == len(rows)


def test_products_in_runs_that_the_cache_holds():
    """times and into give the dense products, and hold no more than a run of them at once."""
    import tracemalloc

    rng = np.random.default_rng(13)
    a = (rng.random((1200, 400)) < 0.08) * rng.random((1200, 400)).astype(np.float32)
    a[7], a[9] = 0, 1  # a row without entries, and a full one
    p, t = np.nonzero(a)
    x, basis = a[p, t], rng.standard_normal((400, 72)).astype(np.float32)
    dc.times(p, t, x, basis)
    tracemalloc.start()
    y, row = dc.times(p, t, x, basis)
    total = np.zeros((400, 72), np.float32)
    dc.into(total, row, t, x, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    some = a.any(1)
    assert np.allclose(y, (a @ basis)[some], atol=1e-4) and np.allclose(total, a[some].T @ y, atol=1e-2)
    assert most < x.nbytes * 72  # the products of all entries would take as much
    none = dc.times(p[:0], t[:0], x[:0], basis)
    assert none[0].shape == (0, 72) and not len(none[1])


def test_products_take_less_than_entry_by_entry():
    """times and into take less CPU time than a multiplication and a sum for each entry, in runs that the cache holds."""
    import time

    rng = np.random.default_rng(17)
    p = np.repeat(np.arange(1500), 28)
    t = np.sort((rng.random((1500, 28)) ** 2 * 12000).astype(np.int64), axis=1).ravel()
    x, basis = rng.random(len(p)).astype(np.float32), rng.standard_normal((12000, 72)).astype(np.float32)

    def summed(of, at, a, y, out):
        order = np.argsort(of, kind="stable")
        of, at, a = of[order], at[order], a[order]
        first = np.append(np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))), len(of))
        i = 0
        while i < len(first) - 1:
            j = max(i + 1, int(np.searchsorted(first, first[i] + 900, side="right")) - 1)
            lo, hi = first[i], first[j]
            out[of[first[i:j]]] += np.add.reduceat(y[at[lo:hi]] * a[lo:hi, None], first[i:j] - lo, axis=0)
            i = j

    def plain():
        y, total = np.zeros((1500, 72), np.float32), np.zeros((12000, 72), np.float32)
        summed(p, t, x, basis, y)
        summed(t.astype(np.uint16), p, x, y, total)
        return total

    def ours():
        total = np.zeros((12000, 72), np.float32)
        y, row = dc.times(p, t, x, basis)
        dc.into(total, row, t, x, y)
        return total

    took = {plain: [], ours: []}
    for _ in range(15):
        for f, seconds in took.items():
            began = time.process_time()
            f()
            seconds.append(time.process_time() - began)
    assert np.allclose(ours(), plain(), atol=1e-3)
    assert min(took[ours]) < 0.8 * min(took[plain])
