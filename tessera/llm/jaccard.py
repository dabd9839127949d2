"""Set-similarity self-join on word n-grams, by rare-first prefix filtering.

A document is the set of its word n-grams, in one order for all: rare ones first. Two sets of Jaccard
similarity t or more share an n-gram in their prefixes of |x| - ceil(t |x|) + 1, so sets are joined on
prefix n-grams alone. At the first n-gram they share, length and position bound the similarity. Sets that
pass at some n-gram meet at a hub (the least set of those that passed there), where a bitmap filter bounds
the overlap of the suffixes, and a pair is verified once, at the least hub that its two sets have in common.
So a group of thousands of copies costs its members' postings, not its pairs, until it is verified. Hubs of
more than ROOM sets are cut in blocks, and each two blocks meet in a task of their own.

The result is a class for each document, with the number of its links: copies aren't expanded into pairs, and
no link between different texts is lost.

Rarity comes from counts over all documents, by hash bucket, of words and of n-grams: an n-gram is as
frequent as its words make one expect, or as its bucket is beyond the usual bucket (a passage that many
documents share). The tables have one size whatever the input, and a wrong guess costs time only, as any
order that is the same for all documents is right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, discard, exchange, packed, shared_dir, split, table, unpacked, written
from .textscan import Words, mix, rolling, spans_hash, words

N = 3
THRESHOLD = 0.6
SKETCH_BITS = 20
SLICES = 16
PART = 1_000_000  # prefix postings in a part
FLUSH = 1_000_000  # and those that a mapper holds
ROOM = 2048  # sets of a hub that one task compares; larger hubs are cut in blocks
_TO_BUCKET = np.uint64(64 - SKETCH_BITS)
_LOW = np.uint64((1 << 56) - 1)
_LIST = 64  # postings of one n-gram up to which pairs are looked at one by one


def grams(w: Words, n: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(document, hash) of each n-gram, and with `weight` (of each word) the sum of its words' weights; a text of fewer than n words, but some, has one n-gram of all of them."""
    count = np.diff(w.first)
    doc = np.repeat(np.arange(w.n), count)
    g = rolling(w.hash, n)
    inside = np.flatnonzero(w.first[doc[: len(g)] + 1] - np.arange(len(g)) >= n)
    d, g, lo, hi = doc[inside], g[inside], inside, inside + n
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        lo, hi = np.concatenate((lo, w.first[short])), np.concatenate((hi, w.first[short + 1]))
        d, g = np.concatenate((d, short)), np.concatenate((g, spans_hash(w.hash, w.first[short], w.first[short + 1])))
    if weight is None:
        return d, g
    total = np.concatenate(([0], np.cumsum(weight, dtype=np.int64)))  # whole numbers: the sum doesn't depend on what is around
    return d, g, total[hi] - total[lo]


class Rarity:
    """Frequency of n-grams as a byte: weights of words and of n-grams' buckets, in sixteenths of a power of two."""

    def __init__(self, words_in: np.ndarray, grams_in: np.ndarray):
        self.total, self.grams = max(1, int(words_in.sum())), int(grams_in.sum())
        self.word = np.round(16 * np.log2(np.maximum(1, words_in) / self.total)).astype(np.int16)
        usual = grams_in.mean()
        beyond = grams_in - usual - 4 * np.sqrt(usual) - 1
        self.gram = np.where(beyond > 0, np.round(16 * np.log2(np.maximum(beyond, 1))), -(1 << 14)).astype(np.int16)
        self.base = round(16 * float(np.log2(self.total)))

    def named(self, w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, name) of each n-gram; names of rare ones are less."""
        d, g, weight = grams(w, n, self.word[w.hash >> _TO_BUCKET])
        level = np.maximum(weight + self.base, self.gram[g >> _TO_BUCKET])
        byte = np.clip(((level + 768) * 3) >> 4, 0, 255).astype(np.uint64)
        return d, (byte << np.uint64(56)) | (g & _LOW)


def rarity(docs: DataFrame, n: int) -> Rarity:
    """Counted over all documents."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size, np.int64)
        for batch in batches:
            for _, _, w in words(batch.column(1)):
                total[:size] += np.bincount(w.hash >> _TO_BUCKET, minlength=size)
                total[size:] += np.bincount(grams(w, n)[1] >> _TO_BUCKET, minlength=size)
        over = np.flatnonzero(total > 65535)  # the few that don't fit the narrow counts
        width = 2 * size // SLICES
        of_over = over // width
        for k in range(SLICES):
            here = over[of_over == k]
            blob = packed(np.array([k])) + packed(np.minimum(total[k * width : (k + 1) * width], 65535).astype(np.uint16)) + packed(here - k * width, total[here] - 65535)
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "blob": pa.array([blob], pa.binary())})

    def add(blobs: Iterator[bytes]) -> pa.Table:
        total, k = np.zeros(2 * size // SLICES, np.int64), 0
        for blob in blobs:
            part, c, at, more = unpacked([blob], ("i8",), ("u2",), ("i8", "i8"))
            total += c
            total[at] += more
            k = int(part[0])
        return pa.table({"slice": pa.array([k], pa.int32()), "counts": [total.tobytes()]})

    total = np.zeros((SLICES, 2 * size // SLICES), np.int64)
    for r in exchange(docs, count, add, "slice int, counts binary").toLocalIterator():  # SLICES rows
        total[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    total = total.ravel()
    return Rarity(total[:size], total[size:])


def ordered_sets(w: Words, n: int, rank: Rarity) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first index of each text's set, names of its n-grams, rare ones first, text of each, fingerprint of each set)."""
    d, name = rank.named(w, n)
    order = np.argsort(name)
    order = order[np.argsort(d[order].astype(np.uint16) if w.n <= 1 << 16 else d[order], kind="stable")]
    name, d = name[order], d[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (d[1:] != d[:-1])
    name, d = name[new], d[new]
    first = np.searchsorted(d, np.arange(w.n + 1))
    total = np.zeros(len(name) + 1, np.uint64)
    np.cumsum(mix(name), out=total[1:])
    mark = mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)) >> np.uint64(1)  # fits a long
    return first, name, d, mark


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _linked(blobs: Iterator[bytes], threshold: float) -> pa.Table:
    """(set, hub) of the sets that pass the length and position filters at some n-gram of this part, and (set, itself) of repeated sets."""
    name, mark, n, rest = unpacked(blobs, ("u8", "u8", "u2", "u1"))
    order = np.argsort(name)
    name = name[order]
    same = name[1:] == name[:-1]
    some = np.zeros(len(name), bool)
    some[1:] |= same
    some[:-1] |= same
    order, name = order[some], name[some]
    mark, n, rest = mark[order], n[order], rest[order]
    order = np.lexsort((mark, name))
    name, mark, n, rest = name[order], mark[order], n[order], rest[order]
    again = np.zeros(len(name), bool)
    again[1:] = (name[1:] == name[:-1]) & (mark[1:] == mark[:-1])
    twins = np.unique(mark[again])
    name, mark, n, rest = name[~again], mark[~again], n[~again], rest[~again]
    run = np.cumsum(np.concatenate(([0], name[1:] != name[:-1]))) if len(name) else np.zeros(0, np.int64)
    length = np.bincount(run)[run] if len(run) else run
    passes = np.zeros(len(name), bool)
    for k in np.unique(run[length > _LIST]).tolist():
        lo, hi = np.searchsorted(run, (k, k + 1))
        passes[lo:hi] = _has_partner(n[lo:hi], rest[lo:hi], threshold)
    small = np.flatnonzero((length > 1) & (length <= _LIST))
    size = n[small].astype(np.float64)
    size_up = np.where(size == 65535, np.inf, size)  # longer sets aren't filtered
    left = np.where(size == 65535, np.inf, rest[small] / 255 * size)
    of = run[small]
    for step in range(1, min(_LIST, len(small))):
        a, b = np.arange(len(small) - step), np.arange(step, len(small))
        pair = of[a] == of[b]
        if not pair.any():
            break
        a, b = a[pair], b[pair]
        least, most = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        good = ((least >= threshold * most - 1e-6) | np.isinf(np.maximum(size_up[a], size_up[b]))) & (np.minimum(left[a], left[b]) >= threshold / (1 + threshold) * (size[a] + size[b]) - 1e-6)
        passes[small[a[good]]] = True
        passes[small[b[good]]] = True
    name, mark = name[passes], mark[passes]
    head = np.concatenate(([True], name[1:] != name[:-1])) if len(name) else np.zeros(0, bool)
    hub = mark[head][np.cumsum(head) - 1] if len(name) else mark  # the least of the run: marks are in order
    both = np.unique(np.column_stack((np.concatenate((mark, twins)), np.concatenate((hub, twins)))), axis=0) if len(mark) + len(twins) else np.zeros((0, 2), np.uint64)
    return pa.table({"mark": pa.array(both[:, 0].astype(np.int64), pa.int64()), "hub": pa.array(both[:, 1].astype(np.int64), pa.int64())})


def _has_partner(n: np.ndarray, rest: np.ndarray, threshold: float) -> np.ndarray:
    """Which sets of a long list pass with some other set of it, by range maxima over the sets in order of size."""
    order = np.argsort(n, kind="stable")
    huge = n[order] == 65535
    size = n[order].astype(np.float64)
    left = np.where(huge, np.inf, rest[order] / 255 * size)
    a = threshold / (1 + threshold)
    spare = left - a * size  # a partner of size m needs spare >= a m of this one, and the other way round
    table = [spare]
    while 2 << len(table) - 1 <= len(size):
        step = 1 << len(table) - 1
        table.append(np.maximum(table[-1][:-step], table[-1][step:]))

    def most(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.full(len(lo), -np.inf)
        some = hi > lo
        level = np.zeros(len(lo), np.int64)
        level[some] = np.log2(hi[some] - lo[some]).astype(np.int64)
        for k, row in enumerate(table):
            at = some & (level == k)
            out[at] = np.maximum(row[lo[at]], row[hi[at] - (1 << k)])
        return out

    low = np.searchsorted(size, threshold * size - 1e-6)
    high = np.searchsorted(size, np.minimum(size / threshold, spare / a) + 1e-6, side="right")
    high[huge] = len(size)
    me = np.arange(len(size))
    need = a * size - 1e-6
    found = (most(low, np.minimum(me, high)) >= need) | (most(me + 1, np.maximum(high, me + 1)) >= need) | huge
    out = np.zeros(len(n), bool)
    out[order] = found | (bool(huge.any()) & (size >= threshold * 65535))
    return out


def bitmaps(first: np.ndarray, name: np.ndarray, d: np.ndarray) -> list[bytes]:
    """Parities of each set's n-grams by hash, in twice as many bits as it has n-grams (a power of two): sets whose bits differ in k places differ in k n-grams at least."""
    width = 1 << np.clip(np.ceil(np.log2(np.maximum(1, 2 * np.diff(first)))).astype(np.int64), 6, 16)
    begin = np.concatenate(([0], np.cumsum(width)))
    at = begin[d] + (mix(name) % width[d].astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=int(begin[-1])) & 1).astype(bool)).tobytes()
    return [bits[lo // 8 : hi // 8] for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def _blocks(m: int, step: int = 1024) -> Iterator[tuple[int, int, int, int]]:
    for i in range(0, m, step):
        for j in range(i, m, step):
            yield i, min(m, i + step), j, min(m, j + step)


def _below(hubs: list[np.ndarray], hub: int) -> np.ndarray:
    """A row for each set: which of the lesser hubs it goes to. Sets with one in common meet there, not here."""
    lower = [h[h < hub] for h in hubs]
    of = {h: k for k, h in enumerate(np.unique(np.concatenate(lower)).tolist())}
    member = np.zeros((len(hubs), len(of)), np.float32)
    for i, hs in enumerate(lower):
        member[i, [of[h] for h in hs.tolist()]] = 1
    return member


def _blocked(todo: np.ndarray, i0: int, i1: int, j0: int, j1: int, block: np.ndarray) -> np.ndarray:
    """todo, and where rows are of two blocks, of rows in either."""
    return todo & (block[i0:i1, None] != block[None, j0:j1]) if block.min() < block.max() else todo


def _folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap with its halves laid over each other until it has `width` bytes: the parities of the narrower one."""
    row = np.frombuffer(bits, np.uint8)
    while len(row) > width:
        half = len(row) // 2
        row = row[:half] ^ row[half:]
    return row


def _sift(size: np.ndarray, hubs: list[np.ndarray], hub: int, bits: list[bytes], threshold: float, block: np.ndarray) -> np.ndarray:
    """Which sets of a hub have a partner there by length and by the bitmap filter, |x n y| = (|x| + |y| - |x ^ y|) / 2."""
    member = _below(hubs, hub)
    out = np.zeros(len(size), bool)
    width = np.array([len(b) for b in bits])
    for w in np.unique(width).tolist():  # each pair is looked at in the width of its narrower one
        own = np.flatnonzero((width >= w) & (width <= w * 4 / threshold))
        matrix = np.unpackbits(np.stack([_folded(bits[i], w) for i in own.tolist()]), axis=1).astype(np.float32)
        total, n, who, of = matrix.sum(1), size[own], member[own], block[own]
        narrow = width[own] == w
        for i0, i1, j0, j1 in _blocks(len(own)):
            ni, nj = n[i0:i1, None], n[None, j0:j1]
            good = (np.minimum(ni, nj) >= threshold * np.maximum(ni, nj) - 1e-6) & (np.arange(i0, i1)[:, None] < np.arange(j0, j1)[None]) & (narrow[i0:i1, None] | narrow[None, j0:j1])
            if block.min() < block.max():
                good &= of[i0:i1, None] != of[None, j0:j1]
            if not good.any():
                continue
            differ = total[i0:i1, None] + total[None, j0:j1] - 2 * (matrix[i0:i1] @ matrix[j0:j1].T)
            good &= (ni + nj - differ) / 2 >= threshold / (1 + threshold) * (ni + nj) - 1e-6
            if good.any() and member.shape[1]:
                good &= (who[i0:i1] @ who[j0:j1].T) == 0
            out[own[i0:i1][good.any(1)]] = True
            out[own[j0:j1][good.any(0)]] = True
    return out


def _verify(hubs: list[np.ndarray], hub: int, sets: list[np.ndarray], threshold: float, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one hub, as places among its sets, and their similarity."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    value, back = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), size)
    shared = np.bincount(back)[back] > 1
    index = np.cumsum(np.bincount(back) > 1) - 1
    col, srow = index[back[shared]], row[shared]
    width = int(col.max()) + 1 if len(col) else 0
    member = _below(hubs, hub)
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    first = np.searchsorted(srow, np.arange(m + 1))
    wide = 4096
    for i0, i1, j0, j1 in _blocks(m):
        ni, nj = size[i0:i1, None], size[None, j0:j1]
        todo = (np.minimum(ni, nj) >= threshold * np.maximum(ni, nj) - 1e-6) & (np.arange(i0, i1)[:, None] < np.arange(j0, j1)[None])
        todo = _blocked(todo, i0, i1, j0, j1, block)
        if member.shape[1]:
            todo &= (member[i0:i1] @ member[j0:j1].T) == 0
        if not todo.any():
            continue
        x, y = np.nonzero(todo)
        if len(x) < 64:
            common = np.array([len(np.intersect1d(sets[i0 + p], sets[j0 + q], assume_unique=True)) for p, q in zip(x.tolist(), y.tolist(), strict=True)], float)
        else:
            overlap = np.zeros((i1 - i0, j1 - j0), np.float32)
            si, sj = slice(first[i0], first[i1]), slice(first[j0], first[j1])
            for c in range(0, width, wide):
                u, v = np.zeros((i1 - i0, wide), np.float32), np.zeros((j1 - j0, wide), np.float32)
                for mat, s, base in ((u, si, i0), (v, sj, j0)):
                    here = (col[s] >= c) & (col[s] < c + wide)
                    mat[srow[s][here] - base, col[s][here] - c] = 1
                overlap += u @ v.T
            common = overlap[x, y].astype(float)
        p, q = x + i0, y + j0
        similar = common / (size[p] + size[q] - common)
        good = similar >= threshold - 1e-12
        for o, c in zip(out, (p[good], q[good], similar[good]), strict=True):
            o.append(c)
    return tuple(np.concatenate(o) for o in out)


def _roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each of m places is connected with."""
    root = np.arange(m)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def _hubs(table: pa.Table) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(hub, rows, their hubs, their blocks) of the meetings of two rows or more."""
    hub, i, j = (table.column(c).to_numpy() for c in ("hub", "i", "j"))
    block = table.column("block").to_numpy()
    order = np.lexsort((j, i, hub))
    h, i, j = hub[order], i[order], j[order]
    edge = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]))) if len(h) else np.zeros(1, np.int64)
    hubs = table.column("hubs")
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        rows = order[lo:hi]
        if hi - lo > 1 and not (i[lo] != j[lo] and block[rows].min() == block[rows].max()):
            yield int(h[lo]), rows, [np.array([x["hub"] for x in hubs[r].as_py()]) for r in rows.tolist()], block[rows]


def _sifted(table: pa.Table, threshold: float) -> pa.Table:
    size, bits, mark, n = table.column("size").to_numpy(), table.column("bits"), table.column("mark").to_numpy(), table.column("n").to_numpy()
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
    for hub, rows, hubs, block in _hubs(table):
        kept = rows[_sift(size[rows], hubs, hub, [bits[r].as_py() for r in rows.tolist()], threshold, block)]
        for o, c in zip(out, (mark[kept], np.full(len(kept), hub), n[kept]), strict=True):
            o.append(c)
    return pa.table(dict(zip(("mark", "hub", "n"), map(np.concatenate, out), strict=True)))


def _verified(table: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, places of the one and of the other of each pair, similarity) of each meeting."""
    grams_of = table.column("grams")
    for hub, rows, hubs, block in _hubs(table):
        yield rows, *_verify(hubs, hub, [np.frombuffer(grams_of[r].as_py(), np.uint64) for r in rows.tolist()], threshold, block)


class _Join:
    """The candidates of a join: groups of documents with equal sets (mark, ids, hubs), and sets that meet at hubs."""

    def __init__(self, docs: DataFrame, n: int, threshold: float, id_col: str, text_col: str):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be above 0, and 1 at most")
        self.threshold = threshold
        spark = docs.sparkSession
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text <> ''")
        rank = rarity(base, n)
        ranks = spark.sparkContext.broadcast(rank)  # 4 MB
        parts = max(1, -(-int(rank.grams * (1 - threshold)) // PART))

        def send(got: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            name, *rest = [np.concatenate(c) for c in got]
            yield from split((mix(name.copy()) % np.uint64(parts)).astype(np.int64), parts, name, *rest)

        def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: list[list[np.ndarray]] = [[], [], [], []]
            held = 0
            for batch in batches:
                for _, _, w in words(batch.column(1)):
                    first, name, d, mark = ordered_sets(w, n, ranks.value)
                    size = np.diff(first)
                    place = np.arange(len(name)) - first[d]
                    keep = place < prefix_length(size, threshold)[d]
                    d, place = d[keep], place[keep]
                    m = size[d]
                    for out, c in zip(got, (name[keep], mark[d], np.minimum(m, 65535).astype("u2"), np.ceil(255 * (m - place) / m).astype("u1")), strict=True):
                        out.append(c)
                    held += len(d)
                    if held >= FLUSH:
                        yield from send(got)
                        got, held = [[], [], [], []], 0
            if held:
                yield from send(got)

        links = written(exchange(base, postings, lambda blobs: _linked(blobs, threshold), "mark long, hub long").distinct())
        # a hub is of use to two sets or more; a repeated set has itself for a hub, alone
        sizes = links.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1")
        met = links.join(sizes, "hub").groupBy("mark").agg(F.array_sort(F.collect_set(F.struct("hub", "n"))).alias("hubs"))
        found = written(links.select("mark").distinct().join(met, "mark", "left"))
        every = spark.sparkContext.broadcast(KeyFilter.of(found.select("mark")))

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, w in words(batch.column(1)):
                    first, name, d, mark = ordered_sets(w, n, ranks.value)
                    rows = np.flatnonzero((np.diff(first) > 0) & every.value.holds(mark))
                    bits = bitmaps(first, name, d)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mark[rows].astype(np.int64), pa.int64()), batch.column(0).slice(i, j - i).take(pa.array(rows)), pa.array(np.diff(first)[rows], pa.int64()), pa.array([bits[k] for k in rows.tolist()], pa.binary())],
                        names=["mark", "doc_id", "size", "bits"],
                    )

        # a row for each set and document, then for each set: equal sets may be a third of all, so they are counted before they move
        same = base.mapInArrow(members, "mark long, doc_id long, size long, bits binary")
        self.documents = written(same.dropDuplicates(["mark", "doc_id"]).join(found.select("mark"), "mark", "left_semi"))
        sets = self.documents.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bits").alias("bits"))
        self.sets = written(sets.join(found, "mark"))
        met_sets = self.sets.where("hubs is not null")
        sifted = self._meet(met_sets.select("mark", "size", "bits", "hubs", F.explode("hubs").alias("at")), parts).applyInArrow(lambda t: _sifted(t, threshold), "mark long, hub long, n long")
        at = sifted.distinct().groupBy("mark").agg(F.collect_list(F.struct("hub", "n")).alias("at"))
        # of equal sets the least document's is sent on
        least = written(met_sets.join(at, "mark").select("mark", "doc_id", "copies", "hubs", "at"))
        senders = spark.sparkContext.broadcast(KeyFilter.of(least.select("mark", "doc_id")))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for i, j, w in words(batch.column(1)):
                    first, name, _, mark = ordered_sets(w, n, ranks.value)
                    rows = np.flatnonzero((np.diff(first) > 0) & senders.value.holds(mark, ids[i:j]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mark[rows].astype(np.int64), pa.int64()), pa.array(ids[i:j][rows], pa.int64()), pa.array([name[first[k] : first[k + 1]].tobytes() for k in rows.tolist()], pa.binary())],
                        names=["mark", "doc_id", "grams"],
                    )

        sent = base.mapInArrow(whole, "mark long, doc_id long, grams binary").dropDuplicates(["mark", "doc_id"]).join(least, ["mark", "doc_id"])
        self.meeting = self._meet(sent.select("mark", "doc_id", "copies", "hubs", "grams", F.explode("at").alias("at")), parts)

    def _meet(self, sets: DataFrame, parts: int):
        """Sets by room: (hub, i, j) is where blocks i and j of a hub meet, and a small hub has one block."""
        blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("at.n") / ROOM))
        cut = sets.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("mark", F.lit(5)), blocks)})
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
        met = cut.withColumn("pair", F.explode(pairs)).withColumns({"hub": F.col("at.hub"), "n": F.col("at.n"), "i": F.col("pair.i"), "j": F.col("pair.j")}).drop("at", "pair", "blocks")
        return met.withColumn("room", F.pmod(F.xxhash64("hub", "i", "j"), F.lit(max(8, parts)))).groupBy("room")

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b, jaccard) of different sets, each by its least document."""
        threshold = self.threshold

        def verify(table: pa.Table) -> pa.Table:
            ids = table.column("doc_id").to_numpy()
            a, b, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for rows, p, q, similar in _verified(table, threshold):
                a.append(np.minimum(ids[rows[p]], ids[rows[q]]))
                b.append(np.maximum(ids[rows[p]], ids[rows[q]]))
                s.append(similar)
            return pa.table({"doc_a": np.concatenate(a), "doc_b": np.concatenate(b), "jaccard": np.concatenate(s)})

        return self.meeting.applyInArrow(verify, "doc_a long, doc_b long, jaccard double")

    def stars(self) -> DataFrame:
        """(mark, doc_id, links, root) of each meeting: documents with which the set has links there, and the least document that these connect it with."""
        threshold = self.threshold

        def verify(table: pa.Table) -> pa.Table:
            ids, mark, copies = (table.column(c).to_numpy() for c in ("doc_id", "mark", "copies"))
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for rows, p, q, _ in _verified(table, threshold):
                if not len(p):
                    continue
                order = np.argsort(ids[rows], kind="stable")
                place = np.empty(len(rows), np.int64)
                place[order] = np.arange(len(rows))
                root = ids[rows[order]][_roots(len(rows), place[p], place[q])][place]
                links = np.zeros(len(rows), np.int64)
                np.add.at(links, p, copies[rows[q]])
                np.add.at(links, q, copies[rows[p]])
                some = links > 0
                for o, c in zip(out, (mark[rows], ids[rows], links, root), strict=True):
                    o.append(c[some])
            return pa.table(dict(zip(("mark", "doc_id", "links", "root"), map(np.concatenate, out), strict=True)))

        return self.meeting.applyInArrow(verify, "mark long, doc_id long, links long, root long")


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of documents whose sets of word n-grams have Jaccard similarity `threshold` or more: doc_a < doc_b, jaccard.

    Documents with equal sets are one set with several documents: each is paired with the least of them,
    and that one stands for them in all other pairs. So no link between different sets is lost; their number
    may grow as the square of a group, so `classes` gives them by document. Texts that are null, empty or
    without words have no n-grams and no pairs; a text of fewer than n words is one n-gram. Very long texts
    are sets like any other. Rows without doc_id have no pairs. Repeated rows are one document; documents
    with one doc_id and different texts are not paired with each other. Other columns are ignored, whatever
    their names. An empty table gives no rows.
    """
    join = _Join(docs, n, threshold, id_col, text_col)
    least = join.sets.where("copies > 1").select("mark", F.col("doc_id").alias("doc_a"))
    twins = join.documents.join(least, "mark").where("doc_id > doc_a").select("doc_a", F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return twins.unionByName(join.pairs().where("doc_a < doc_b"))


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document that has a near duplicate: doc_id, class_id (the least doc_id that it is connected with), links
    (how many other documents have Jaccard similarity `threshold` or more with it, copies and all).

    Documents that are not listed have no links, and are classes of their own. Edge cases are those of
    similar_pairs; of documents with one doc_id and several texts, the links are summed.
    """
    join = _Join(docs, n, threshold, id_col, text_col)
    stars = written(join.stars())
    near = stars.groupBy("mark").agg(F.sum("links").alias("near"))
    linked = join.sets.join(near, "mark", "left").select("mark", F.col("doc_id").alias("least"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links")).where("links > 0")
    by_document = written(join.documents.join(linked, "mark").groupBy("doc_id").agg(F.min("least").alias("least"), F.sum("links").cast("long").alias("links"), F.collect_set("least").alias("all")))
    # documents with one doc_id and several texts tie the classes of these
    edges = stars.select(F.col("doc_id").alias("doc_a"), F.col("root").alias("doc_b")).union(by_document.where(F.size("all") > 1).select("least", F.explode("all")))
    roots = components(edges).select(F.col("id").alias("least"), "root")
    return by_document.join(roots, "least", "left").select("doc_id", F.coalesce("root", "least").alias("class_id"), "links")


def components(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """(id, root): the least id that each id of the pairs is connected with, by alternating large and small stars."""
    edges = written(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # large star: neighbours above a node are tied to the least of its neighbours and itself
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and those below it are tied to the least below it
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, edges = edges, written(small)
        discard(last)
        mark = tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if mark == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = mark


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near duplicates: of each class the least doc_id stays. Rows without doc_id stay, and those whose
    text is null, empty or without words; of rows with one doc_id, all stay or go. All columns stay as they are, whatever their names."""
    drop = classes(docs, n, threshold, id_col, text_col).where("doc_id <> class_id").select(F.col("doc_id").alias(id_col))
    return docs.join(drop, id_col, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return classes(table(spark, sf_dir, "documents"))
