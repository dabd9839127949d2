"""Benchmark decontamination by latent semantic retrieval, verified by longest common subsequences.

1. Documents are passages of WIDTH words, rows of a matrix of tf-idf weights of unit length. Each word of the
   benchmark has a column, and all other words share OTHERS hashed columns.
2. A randomised SVD of that matrix with the benchmark's rows below it, both parts scaled to one norm. Every task
   multiplies its passages into A'(A omega), for RANK + OVERSAMPLE random columns, and the sums are added in
   slices; their orthonormal base Q holds the leading row space. A second pass adds up (AQ)'(AQ), whose
   eigenvectors turn Q into right singular vectors, and whose eigenvalues are the squared singular values.
3. Passages whose cosine with an item in the latent space is COSINE or more are candidates, in steps of
   STEP words, from every document. Items that the latent space holds badly (more of them than its rank, or of
   rare words) are searched by all of their words. Items of fewer than LEAST_WORDS words are searched as they are.
4. A candidate is held against the item by the longest common subsequence of words and by how much of the
   item's answer, its last sentence, is there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exchange, split, table, unpacked, unused
from .textscan import Words, expand, hash_of, rolling, words

WIDTH, STEP = 32, 16
RANK, OVERSAMPLE = 64, 8
KEPT = 0.8  # an item of less of its length in the latent space is searched by all of its words
COSINE = 0.35
COVERAGE = 0.8  # share of an item's words, in order, that is a leak by itself
PARAPHRASE, ANSWER = 0.55, 0.6  # or this share, with this share of the answer
LEAST_WORDS = 5  # of an item that is searched by similarity; a shorter one is found where its words follow each other
BITS, OTHERS = 20, 13  # the benchmark's words by so many bits of their hash, and the hashed columns of other words, as powers of two
SLICES = 16
ITEMS = 20_000  # items that are searched at once; a larger benchmark is searched in blocks
_CACHED = 1 << 16  # numbers that are multiplied at once, as the cache holds them
_CELLS = 8_000_000  # numbers of columns x items that a task holds at once


class Benchmark:
    """Items' words, and the columns of words by hash."""

    def __init__(self, items: list[tuple[int, str]]):
        got = [(i, np.array(hash_of(t), np.uint64), self.answer_of(t)) for i, t in items]
        self.short: dict[int, list[tuple[int, int]]] = {}  # (hash of all words, item) by number of words
        for i, h, _ in got:
            if 0 < len(h) < LEAST_WORDS:
                self.short.setdefault(len(h), []).append((int(rolling(h, len(h))[0]), i))
        got = [x for x in got if len(x[1]) >= LEAST_WORDS]
        self.ids = [x[0] for x in got]
        self.words = [x[1] for x in got]
        self.answers = [np.array(a if len(a) >= 3 else w[-max(3, len(w) // 4) :], np.uint64) for _, w, a in got]
        bucket = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]) >> np.uint64(64 - BITS)).astype(np.int64)
        self.column = np.full(1 << BITS, -1, np.int32)
        self.column[bucket] = np.arange(len(bucket))
        self.size = len(bucket)
        self.width = self.size + (1 << OTHERS)

    @staticmethod
    def answer_of(text: str) -> list[int]:
        ends = [p for p in re.split(r"[.?!\n]+", text) if p.strip()]
        return hash_of(ends[-1]) if len(ends) > 1 else []

    def columns(self, h: np.ndarray) -> np.ndarray:
        own = self.column[h >> np.uint64(64 - BITS)].astype(np.int64)
        return np.where(own >= 0, own, self.size + ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - OTHERS)).astype(np.int64))

    def rows(self, idf: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, column, weight) of the unit tf-idf rows of items first : last, in order."""
        some = self.words[first:last]
        of = np.repeat(np.arange(len(some)), [len(h) for h in some])
        p, t, n = counts(of, self.columns(np.concatenate([np.zeros(0, np.uint64), *some])), self.width)
        x = n * idf[t].astype(np.float64)
        return p, t, (x / np.maximum(1e-9, np.sqrt(np.bincount(p, x * x, minlength=len(some))))[p]).astype(np.float32)


def cells(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each word, number of cells before each text): texts are cut in cells of `width` words."""
    count = np.diff(w.first)
    before = np.concatenate(([0], np.cumsum(-(-count // width))))
    doc = np.repeat(np.arange(w.n), count)
    return before[doc] + (np.arange(len(doc)) - w.first[doc]) // width, before


def counts(cell: np.ndarray, col: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, column, times) of the words, in order."""
    key, n = np.unique(cell * size + col, return_counts=True)
    return key // size, key % size, n


def frequencies(docs: DataFrame, bench: Benchmark) -> np.ndarray:
    """idf of each column over all passages: of the benchmark's words by the passages that hold them, of hashed columns by the words that fall there. It is 1 at least, so that items of common words can be found."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(bench.width, np.int64), 0
        for batch in batches:
            for _, _, w in words(batch.column(0)):
                cell, before = cells(w, WIDTH)
                col = bench.columns(w.hash)
                own = col < bench.size
                df += np.bincount(counts(cell[own], col[own], bench.size)[1], minlength=bench.width) if own.any() else 0
                df += np.bincount(col[~own], minlength=bench.width)
                n += int(before[-1])
        yield pa.RecordBatch.from_pydict({"col": pa.array(range(-1, bench.width), pa.int32()), "n": pa.array([n, *df.tolist()], pa.int64())})

    rows = docs.mapInArrow(count, "col int, n long").groupBy("col").agg(F.sum("n").alias("n")).collect()  # a row for each column
    df = np.zeros(bench.width + 1)
    for r in rows:
        df[r["col"]] = r["n"]  # the last is the number of passages
    return (1 + np.maximum(0, np.log((df[-1] + 1) / (df[:-1] + 0.5)))).astype(np.float32)


def passages(w: Words, bench: Benchmark, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passage, column, weight) of runs of passages, as unit rows in order."""
    cell, before = cells(w, WIDTH)
    if not len(cell):
        return
    p, t, n = counts(cell, bench.columns(w.hash), bench.width)
    x = n * idf[t]
    x /= np.maximum(1e-9, np.sqrt(np.bincount(p, x.astype(np.float64) ** 2, minlength=int(before[-1]))))[p]
    edge = np.searchsorted(p, np.arange(0, int(before[-1]) + 1500, 1500))
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if hi > lo:
            yield p[lo:hi], t[lo:hi], x[lo:hi].astype(np.float32)


def times(p: np.ndarray, t: np.ndarray, x: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(product with the basis of each row that has entries, the row of each entry among these)."""
    head = np.concatenate(([True], p[1:] != p[:-1]))[: len(p)]
    first = np.append(np.flatnonzero(head), len(p))
    out = np.zeros((len(first) - 1, basis.shape[1]), np.result_type(basis, x))
    _add(out, np.arange(len(out)), first, t, x, basis)
    return out, np.cumsum(head) - 1


def into(total: np.ndarray, row: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """total += A'y."""
    order = np.argsort(t.astype(np.uint16) if len(total) <= 1 << 16 else t, kind="stable")
    t, row, x = t[order], row[order], x[order]
    first = np.append(np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))[: len(t)]), len(t))
    _add(total, t[first[:-1]], first, row, x, y)


def _add(out: np.ndarray, to: np.ndarray, first: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """out[to[i]] += the sum of x * y[at] over the entries first[i] : first[i + 1], of which there are some, in products of small matrices.

    Those with as many entries are multiplied together, in runs that the cache holds; a longer one is a run of its own."""
    count = np.diff(first)
    if not len(count):
        return
    order = np.argsort(count.astype(np.uint16) if count.max() < 1 << 16 else count, kind="stable")
    count = count[order]
    ends = np.append(np.flatnonzero(np.concatenate(([True], count[1:] != count[:-1]))), len(count))
    wide = y.shape[1]
    most = max(1, _CACHED // max(1, wide))
    room = np.empty((max(most, int(count[-1])), wide), y.dtype)
    for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        n = int(count[begin])
        for i in range(begin, end, max(1, most // n)):
            some = order[i : min(end, i + max(1, most // n))]
            entry = first[some][:, None] + np.arange(n)
            # all places are within y, and "clip" saves a copy of what is taken
            taken = np.take(y, at[entry].ravel(), axis=0, out=room[: entry.size], mode="clip")
            out[to[some]] += np.matmul(x[entry][:, None, :], taken.reshape(len(some), n, wide))[:, 0]


def latent_space(docs: DataFrame, bench: Benchmark, idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors, columns x rank; singular values) of the passages with the items below them, each part scaled to norm 1."""
    spark = docs.sparkSession
    width = bench.width
    wide = min(rank + OVERSAMPLE, width)
    omega = np.random.default_rng(7).standard_normal((width, wide)).astype(np.float32)
    sent = spark.sparkContext.broadcast((idf, omega))  # of one size for a benchmark: columns x (RANK + OVERSAMPLE)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, omega = sent.value
        total, n = np.zeros((width, wide), np.float32), 0
        for batch in batches:
            for _, _, w in words(batch.column(0)):
                for p, t, x in passages(w, bench, idf):
                    y, row = times(p, t, x, omega)
                    into(total, row, t, x, y)
                    n += len(y)
        at = np.arange(width)
        yield from split(at * SLICES // width, SLICES, at.astype(np.int64), np.full(width, n, np.int64), total)

    def add(blobs: Iterator[bytes]) -> pa.Table:
        total, rows, passages_in = None, None, 0
        for blob in blobs:
            rows, n, part = unpacked([blob], ("i8", "i8", f"({wide},)f4"))
            total = part.astype(np.float64) if total is None else total + part
            passages_in += int(n[0])
        return pa.table({"first": pa.array([int(rows[0])], pa.int64()), "n": pa.array([passages_in], pa.int64()), "sums": [total.astype(np.float32).tobytes()]})

    g, n = np.zeros((width, wide)), 0
    for r in exchange(docs, multiply, add, "first long, n long, sums binary").collect():  # SLICES rows: columns x (RANK + OVERSAMPLE) in all
        part = np.frombuffer(r["sums"], np.float32).reshape(-1, wide)
        g[r["first"] : r["first"] + len(part)] = part
        n = r["n"]
    items = bench.rows(idf)
    own = np.zeros((width, wide), np.float32)
    y, row = times(*items, omega)
    into(own, row, items[1], items[2], y)
    # rows are of length 1, so a part's squared norm is its number of rows
    q = np.linalg.qr(g / max(1, n) + own / max(1, len(y)))[0].astype(np.float32)
    base = spark.sparkContext.broadcast((idf, q))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, q = base.value
        total = np.zeros((wide, wide))
        for batch in batches:
            for _, _, w in words(batch.column(0)):
                for p, t, x in passages(w, bench, idf):
                    y, _ = times(p, t, x, q)
                    total += y.T @ y
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(wide * wide), pa.int32()), "v": total.ravel()})

    small = np.zeros(wide * wide)
    for r in docs.mapInArrow(project, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # (RANK + OVERSAMPLE) squared rows
        small[r["at"]] = r["v"]
    y, _ = times(*items, q)
    value, turn = np.linalg.eigh(small.reshape(wide, wide) / max(1, n) + y.astype(np.float64).T @ y / max(1, len(y)))
    lead = np.argsort(-value, kind="stable")[:rank]
    return (q @ turn[:, lead]).astype(np.float32), np.sqrt(np.maximum(0, value[lead]))


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with one bit for each element of a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        m = masks.get(y)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = COSINE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item that it holds: doc_id, key (hash of its text), item_id, cosine (of its best passage), coverage, answer.

    A document is reported when coverage (longest common subsequence of the item and the words about a
    candidate passage, as a share of the item) is COVERAGE, or PARAPHRASE with ANSWER of the answer; for an item
    of fewer than LEAST_WORDS words, where all of its words follow each other.
    Null and empty texts hold nothing, and very long ones are searched whole; items that are null or without words
    aren't searched; items with one item_id are searched each by itself and reported by the best (greatest coverage,
    then answer). A null doc_id is kept. A repeated row is reported each time. Other columns are ignored, whatever
    their names. An empty table of either kind gives no rows.
    """
    schema = "doc_id long, key long, item_id long, cosine double, coverage double, answer double"
    wanted = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("t is not null and i is not null").distinct().orderBy("i", "t")
    items = [(r[0], r[1]) for r in wanted.collect()]  # the query set
    blocks: list[list[tuple[int, str]]] = []
    for item in items:  # texts of one item_id stay together
        if not blocks or (len(blocks[-1]) >= ITEMS and blocks[-1][-1][0] != item[0]):
            blocks.append([])
        blocks[-1].append(item)
    base = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key")).where("text <> ''")
    found = [_leaks(base, Benchmark(block), rank, cosine, schema) for block in blocks]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], schema)


def item_parts(bench: Benchmark, idf: np.ndarray, basis: np.ndarray, first: int, last: int) -> np.ndarray:
    """What a word of the benchmark adds to the cosine with items first : last, columns x items. An item that the latent space holds is
    compared there (a word goes into the space, and is multiplied with the item there), another one by its own words."""
    p, t, x = bench.rows(idf, first, last)
    n = min(last, len(bench.words)) - first
    of_items = np.zeros((n, basis.shape[1]), np.float32)
    y, row = times(p, t, x, basis)
    of_items[p[np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))]] = y
    length = np.linalg.norm(of_items, axis=1)
    out = np.zeros((bench.size, n), np.float32)
    out[t, p] = x
    held = np.flatnonzero(length >= KEPT)
    out[:, held] = basis[: bench.size] @ (of_items[held] / length[held, None]).T
    return out


def _leaks(base: DataFrame, bench: Benchmark, rank: int, cosine: float, schema: str) -> DataFrame:
    only = base.select("text")
    idf, basis = np.zeros(bench.width, np.float32), np.zeros((bench.width, 1), np.float32)
    if bench.ids:
        idf = frequencies(only, bench)
        basis, _ = latent_space(only, bench, idf, rank)
    step = max(1, _CELLS // max(1, bench.size))
    sent = base.sparkSession.sparkContext.broadcast((bench, idf, basis))  # bounded by ITEMS

    def short_ones(w: Words, rows: list[tuple]) -> None:
        for n, known in bench.short.items():
            h = rolling(w.hash, n)
            doc = np.searchsorted(w.first, np.arange(len(h)), side="right") - 1
            inside = np.arange(len(h)) + n <= w.first[doc + 1]
            for mark, item in known:
                for d in np.unique(doc[inside & (h == np.uint64(mark))]).tolist():
                    rows.append((d, item))

    def candidates(w: Words, blocks: list[tuple[int, np.ndarray, np.ndarray]], idf: np.ndarray) -> Iterator[tuple[int, int, float, np.ndarray]]:
        """(text, item, cosine, the words about it) of passages that may hold an item."""
        cell, before = cells(w, STEP)
        total = int(before[-1])
        if not total or not blocks:
            return
        col = bench.columns(w.hash)
        weight = idf[col].astype(np.float64) ** 2
        own = col < bench.size
        mine, rest, number = (np.bincount(cell, v, minlength=total + 1) for v in (weight * own, weight * ~own, (own & (weight > 0)).astype(float)))
        # a passage is a cell and the next one of its text
        text_of = np.repeat(np.arange(w.n), np.diff(before))
        more = np.zeros(total, bool)
        more[:-1] = text_of[1:] == text_of[:-1]
        inside, outside, number = (v[:-1] + np.where(more, v[1:], 0) for v in (mine, rest, number))
        # a word that occurs k times weighs k * k, which is k times its part here and no more than `number` times; a passage that fails this has a lower cosine
        likely = np.flatnonzero((inside > 0) & (inside * number >= cosine**2 * (inside * number + outside)))
        if not len(likely):
            return
        first_word = np.searchsorted(cell, np.arange(total + 1))
        lo, hi = first_word[likely], first_word[np.minimum(likely + 1 + more[likely], total)]
        owner, k = expand(hi - lo)
        at = lo[owner] + k
        keep = own[at] & (weight[at] > 0)
        p_all, t_all, n = counts(owner[keep], col[at[keep]], bench.size)
        x_all = (n * idf[t_all]).astype(np.float32)
        # foreign words are held for single ones: where they share a column or come again, the cosine is no less
        norm = np.sqrt(np.bincount(p_all, x_all.astype(np.float64) ** 2, minlength=len(likely)) + outside[likely])
        for base_item, parts, most in blocks:
            # the sum of each word's greatest part bounds the cosine with any item
            able = np.bincount(p_all, x_all * most[t_all], minlength=len(likely)) >= cosine * norm - 1e-6
            p, t, x = p_all[able[p_all]], t_all[able[p_all]], x_all[able[p_all]]
            if not len(p):
                continue
            head = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            for b in range(0, len(head), 1024):
                e = min(len(head), b + 1024)
                s0, s1 = head[b], head[e] if e < len(head) else len(p)
                passage = p[head[b:e]]
                near = times(p[s0:s1], t[s0:s1], x[s0:s1], parts)[0] / np.maximum(1e-9, norm[passage])[:, None]
                for q, item in zip(*divmod(np.flatnonzero(near >= cosine), near.shape[1]), strict=True):
                    j = passage[q]
                    doc = int(text_of[likely[j]])
                    size = len(bench.words[base_item + item])
                    yield doc, int(base_item + item), float(near[q, item]), w.hash[max(w.first[doc], lo[j] - size) : min(w.first[doc + 1], hi[j] + size)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench, idf, basis = sent.value
        blocks = []
        for first in range(0, len(bench.ids), step):
            parts = item_parts(bench, idf, basis, first, first + step)
            blocks.append((first, parts, np.maximum(0, parts.max(axis=1))))
        for batch in batches:
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for i, _, w in words(batch.column(0)):
                short: list[tuple] = []
                short_ones(w, short)
                for doc, item in short:
                    best[(doc + i, item)] = (1.0, 1.0, 1.0)
                for doc, item, near, region in candidates(w, blocks, idf):
                    mine = bench.words[item]
                    covered = common_length(mine, region) / len(mine)
                    if covered < PARAPHRASE:
                        continue
                    answer = common_length(bench.answers[item], region) / len(bench.answers[item])
                    if covered >= COVERAGE or answer >= ANSWER:
                        key = (doc + i, bench.ids[item])
                        old = best.get(key, (0.0, 0.0, 0.0))
                        best[key] = (max(old[0], min(1.0, near)), *max(old[1:], (covered, answer)))
            keys = list(best)
            of = pa.array([k[0] for k in keys], pa.int64())
            values = list(best.values())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(of), batch.column(2).take(of), pa.array([k[1] for k in keys], pa.int64()), *[pa.array([v[j] for v in values], pa.float64()) for j in range(3)]],
                names=["doc_id", "key", "item_id", "cosine", "coverage", "answer"],
            )

    return base.mapInArrow(search, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns, whatever their names. Rows with null or empty text stay;
    a null doc_id is one like any other; of repeated rows all stay or go; an empty benchmark takes nothing."""
    ident, key = unused(docs, "text_id", "text_key")
    hit = leaks(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias(ident), F.col("key").alias(key)).distinct()
    keyed = docs.withColumns({ident: F.col(id_col).cast("long"), key: F.xxhash64(text_col)})
    return keyed.join(hit, keyed[ident].eqNullSafe(hit[ident]) & (keyed[key] == hit[key]), "left_anti").select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")
