"""Substring dedup by seed and extend, on words.

Seeds are the winnowed anchors of a document: of every WINDOW consecutive K-word hashes the least one. A
passage of K + WINDOW - 1 = LENGTH words or more has an anchor wherever it occurs, so documents are joined
on anchors. Anchors that occur once are dropped first, by a table of bits. An occurrence of another goes to
the anchor's task with the words about it, and is extended there word by word to the right and to the left,
for as long as another occurrence of the anchor agrees: occurrences are kept in classes of equal words, and
a word further each class is parted by the next word. Where a stretch of LENGTH words is in a class of two
or more, it is a repeat. Stretches of a document that overlap are one maximal repeat.

Classes are parted by sorting, not pair by pair, so a passage that very many documents share costs in
proportion to its occurrences. Anchors of more than HOT occurrences never meet in one task: their stretches
are counted by fingerprint with partial sums, and joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_slice, collected_bits, exchange, shared_dir, split, table, unpacked, unused, written
from .textscan import Words, expand, mix, rolling, spans_hash, words

LENGTH = 50  # words of the shortest repeat
K = 20
PER_PART = 60_000  # seeds in a part, about
BYTES_PER_WORD = 5
FLUSH = 1_500_000  # stretches that a mapper holds
BITS_MOST = 29  # of the table of repeated names, as a power of two: 64 MB; a full table only lets more through
HOT = 1_000_000  # occurrences of a seed beyond which it is joined by fingerprints of its stretches
_SALT = np.uint64(0x2545F4914F6CDD1D)

# (text, first stretch, word that names it, name, number of stretches) of each seed of a run of texts; stretches are named by their first word
Seeds = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def least_of(h: np.ndarray, window: int) -> np.ndarray:
    """Index of the least of h[i : i + window] for each i; the last one of equals."""
    n = len(h) - window + 1
    best = np.arange(len(h))
    span = 1
    while span < window:  # doubling; the last step overlaps
        step = min(span, window - span)
        m = len(best) - step
        left, right = best[:m], best[step:]
        best = np.where(h[left] < h[right], left, right)
        span += step
    return best[:n]


def anchors(w: Words, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word index in the chunk, word index of its anchor) of each stretch of `length` words that lies within a text."""
    window = length - k + 1
    h = rolling(w.hash, k)
    if len(h) < window:
        return (np.zeros(0, np.int64),) * 3
    count = np.diff(w.first)
    doc = np.repeat(np.arange(w.n), count)
    least = least_of(h, window)
    inside = np.flatnonzero(w.first[doc[: len(least)] + 1] - np.arange(len(least)) >= length)
    return doc[inside], inside, least[inside]


def anchor_seeds(w: Words, length: int, k: int) -> Seeds:
    d, begin, at = anchors(w, length, k)
    if not len(d):
        return d, begin, at, np.zeros(0, np.uint64), d
    lead = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (d[1:] != d[:-1]))))
    return d[lead], begin[lead], at[lead], mix(rolling(w.hash, k)[at[lead]] ^ _SALT), np.diff(np.append(lead, len(at)))


def repeated_names(base: DataFrame, seeds: Callable[[Words], Seeds], total: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, a table of 2^bits bits by the names' first ones, hot names): names of seeds that occur more than once, out of about `total`."""
    bits = int(np.clip(np.ceil(np.log2(8 * max(1, total))), 17, BITS_MOST))
    by = int(np.clip(np.ceil(np.log2(max(1, total) / 500_000)), 5, 14))
    hot_from = HOT

    def send(names: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        name, n = np.unique(np.concatenate(names), return_counts=True)
        yield from split((name >> np.uint64(64 - by)).astype(np.int64), 1 << by, name, np.minimum(n, 65535).astype("u2"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = [], 0
        for batch in batches:
            for _, _, w in words(batch.column(2)):
                names.append(seeds(w)[3])
                held += len(names[-1])
                if held >= FLUSH // 4:
                    yield from send(names)
                    names, held = [], 0
        if held:
            yield from send(names)

    def add(blobs: Iterator[bytes]) -> pa.Table:
        name, n = unpacked(blobs, ("u8", "u2"))
        value, back = np.unique(name, return_inverse=True)
        times = np.bincount(back, n, minlength=len(value))
        out = bit_slice((value[times > 1] >> np.uint64(64 - bits)).astype(np.int64), bits, by)
        return out.append_column("hot", pa.array([value[times > hot_from].tobytes()], pa.binary()))

    rows = exchange(base, count, add, "slice int, bits binary, hot binary").collect()  # 2^bits bits in all, and fewer hot names than all seeds by HOT
    hot = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["hot"], np.uint64) for r in rows]])
    return bits, collected_bits(rows, bits, by), np.sort(hot)


def contexts(w: Words, seeds: Seeds, key: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(name, key, doc, place of the name, words to its left, stretches, mark of the context) of each seed, and the words of the contexts."""
    d, begin, at, name, n = seeds
    counts = n - 1 + length
    owner, k = expand(counts)
    short = (w.hash >> np.uint64(32)).astype(np.uint32)
    mark = mix(spans_hash(w.hash, begin, begin + counts) ^ (name + ((at - begin).astype(np.uint64) << np.uint64(8)) + n.astype(np.uint64)))
    return name, key, doc, (at - w.first[d]).astype("u4"), (at - begin).astype("u1"), n.astype("u1"), mark, short[begin[owner] + k]


def sent_once(got: list[list[np.ndarray]], parts: int, length: int) -> Iterator[pa.RecordBatch]:
    """Occurrences by name; a context that is here again is sent once."""
    name, key, doc, pos, left, n, mark, word = (np.concatenate(c) for c in got)
    part = (name % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((mark, part))  # contexts in order of part, as split() has them
    new = np.concatenate(([True], (mark[order][1:] != mark[order][:-1]) | (part[order][1:] != part[order][:-1])))
    lead = order[new]
    number = np.empty(len(name), np.int64)
    number[order] = np.cumsum(new) - 1
    before = np.concatenate(([0], np.cumsum(np.bincount(part[lead], minlength=parts))))
    of = (number - before[part]).astype("u4")
    counts = n.astype(np.int64) - 1 + length
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
    owner, k = expand(counts[lead])
    yield from split(part, parts, name, key, doc, pos, of, detail=(part[lead], left[lead], n[lead]), more=(part[lead][owner], word[begin[lead][owner] + k]))


class Occurrences:
    """What a part has: seeds in order of (name, doc, key, pos), each once, and the context of each: the words of all its stretches.

    Contexts that a mapper met more than once were sent once: context[i] begins at word first[i] of `words`."""

    def __init__(self, blobs: Iterator[bytes], length: int):
        columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        texts: list[np.ndarray] = []
        at = 0
        for blob in blobs:
            name, key, doc, pos, of, left, n, of_words = unpacked([blob], ("u8", "i8", "i8", "u4", "u4"), ("u1", "u1"), ("u4",))
            first = at + np.concatenate(([0], np.cumsum(n.astype(np.int64) - 1 + length)))
            at = int(first[-1])
            for o, c in zip(columns, (name, key, doc, pos, left[of], n[of], first[of]), strict=True):
                o.append(c)
            texts.append(of_words)
        kinds = ("u8", "i8", "i8", "u4", "u1", "u1", "i8")
        name, key, doc, pos, left, n, first = (np.concatenate([np.zeros(0, k), *c]) for c, k in zip(columns, kinds, strict=True))
        self.words = np.concatenate([np.zeros(0, np.uint32), *texts])
        order = np.lexsort((pos, key, doc, name))
        name, key, doc, pos = name[order], key[order], doc[order], pos[order]
        # a repeated row is one document
        fresh = np.ones(len(name), bool)
        fresh[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
        alone = np.zeros(len(name), bool)
        if len(name):
            group = np.cumsum(np.concatenate(([True], name[1:] != name[:-1]))) - 1
            alone = np.bincount(group, fresh)[group] < 2
        keep = fresh & ~alone
        self.name, self.key, self.doc, self.pos = name[keep], key[keep], doc[keep], pos[keep].astype(np.int64)
        self.left, self.n, self.first = left[order][keep].astype(np.int64), n[order][keep].astype(np.int64), first[order][keep]


def _parted(cls: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Classes of `cls` parted by the next word; -1 for who is alone."""
    _, back, times = np.unique((cls.astype(np.uint64) << np.uint64(32)) | word, return_inverse=True, return_counts=True)
    return np.where(times[back] > 1, back, -1)


def _extended(blobs: Iterator[bytes], length: int) -> pa.Table:
    """Spans of stretches that occur more than once at a seed of this part, and whether they came before."""
    o = Occurrences(blobs, length)
    m = len(o.name)
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)] + [[np.zeros(0, bool)]]
    if not m:
        return _spans(*[np.concatenate(c) for c in out])
    at = o.first + o.left  # the seed's first word
    least = o.left - o.n + 1  # words to the left of it, at least
    seed = (np.cumsum(np.concatenate(([True], o.name[1:] != o.name[:-1]))) - 1).astype(np.int64)

    def walk(reach: np.ndarray, step: Callable[[int], int], keep_from: int) -> dict[int, np.ndarray]:
        """Classes after each number of words; -1 for who has no more words or no one that agrees."""
        found, cls = {}, seed
        live = np.arange(m)
        for t in range(int(reach.max()) + 1):
            if t:
                live = live[reach[live] >= t]
                now = np.full(m, -1, np.int64)
                now[live] = _parted(cls[live], o.words[at[live] + step(t)])
                cls, live = now, live[now[live] >= 0]
            if t >= keep_from:
                found[t] = cls
            if not len(live):
                break
        return found

    right = walk(length - least, lambda t: t - 1, int(length - o.left.max()))
    left = walk(o.left, lambda t: -t, 0)
    for t in sorted(left):
        if length - t not in right:
            continue
        one, two = left[t], right[length - t]
        rows = np.flatnonzero((one >= 0) & (two >= 0) & (least <= t) & (t <= o.left))
        if not len(rows):
            continue
        _, lead, back, times = np.unique(one[rows] * m + two[rows], return_index=True, return_inverse=True, return_counts=True)
        head = rows[lead[back]]  # occurrences are in order of document: the first of equals came first
        start = o.pos[rows] - t
        elsewhere = (o.doc[rows] != o.doc[head]) | (o.key[rows] != o.key[head])
        late = (head != rows) & (elsewhere | (o.pos[rows] - o.pos[head] >= length))
        again = times[back] > 1
        for c, v in zip(out, (o.key[rows], o.doc[rows], start, start + length, late), strict=True):
            c.append(v[again])
    key, doc, start, end, late = (np.concatenate(c) for c in out)
    return _spans(*merge(key, doc, start, end, late)) if len(key) else _spans(key, doc, start, end, late)


def _spans(key: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, later: np.ndarray) -> pa.Table:
    return pa.table({"key": key, "doc_id": doc, "start": start, "end": end, "later": later})


def merge(key: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of one document and kind that overlap or meet, joined."""
    order = np.lexsort((start, later, key, doc))
    key, doc, start, end, later = key[order], doc[order], start[order], end[order], later[order]
    group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (later[1:] != later[:-1]))))
    base = group * (int(end.max()) + 2)
    reach = np.maximum.accumulate(base + end)
    new = np.concatenate(([True], base[1:] + start[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(new) - 1]))
    return key[new], doc[new], start[new], reach[last] - base[last], later[new]


def seeded_spans(docs: DataFrame, length: int, seeds: Callable[[Words], Seeds], words_per_seed: float, reduce: Callable[[Iterator[bytes]], pa.Table], id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, start, end, later): spans of words of which every stretch of `length` is repeated; later: it came before, in a document of less (doc_id, key) or wholly further up. key is a hash of the text."""
    spark = docs.sparkSession
    base = docs.select(F.xxhash64(text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text <> ''")
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    total = int(size / BYTES_PER_WORD / words_per_seed) + 1
    parts = total // PER_PART + 1
    sent = spark.sparkContext.broadcast(repeated_names(base, seeds, total))
    any_hot = bool(len(sent.value[2]))

    def live(w: Words) -> tuple[Seeds, np.ndarray]:
        """Seeds that may occur again, and which of them are hot."""
        found = seeds(w)
        bits, there, hot = sent.value
        at = (found[3] >> np.uint64(64 - bits)).astype(np.int64)
        again = (there[at >> 3] >> (at & 7)) & 1 > 0
        found = tuple(c[again] for c in found)
        return found, np.isin(found[3], hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[] for _ in range(8)]
        held = 0
        for batch in batches:
            key, doc = (batch.column(c).to_numpy() for c in (0, 1))
            for i, _, w in words(batch.column(2)):
                found, hot = live(w)
                some = tuple(c[~hot] for c in found)
                if not len(some[0]):
                    continue
                for out, c in zip(got, contexts(w, some, key[i + some[0]], doc[i + some[0]], length), strict=True):
                    out.append(c)
                held += int(some[4].sum())
                if held >= FLUSH:
                    yield from sent_once(got, parts, length)
                    got, held = [[] for _ in range(8)], 0
        if held:
            yield from sent_once(got, parts, length)

    schema = "key long, doc_id long, start long, end long, later boolean"
    spans = exchange(base, cut, reduce, schema)
    if not any_hot:
        return spans

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc = (batch.column(c).to_numpy() for c in (0, 1))
            for i, _, w in words(batch.column(2)):
                found, hot = live(w)
                d, begin, _, _, n = (c[hot] for c in found)
                if len(d):
                    owner, k = expand(n)
                    d, begin = d[owner], begin[owner] + k
                    print_ = rolling(w.hash, length)[begin].astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"print": print_, "key": key[i + d], "doc_id": doc[i + d], "start": begin - w.first[d]})

    each = base.mapInArrow(stretches, "print long, key long, doc_id long, start long").distinct()
    known = each.groupBy("print").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "start")).alias("head")).where("n > 1")
    late = ((F.col("doc_id") != F.col("head.doc_id")) | (F.col("key") != F.col("head.key"))) | (F.col("start") - F.col("head.start") >= length)
    return spans.unionByName(each.join(known, "print").select("key", "doc_id", "start", (F.col("start") + length).alias("end"), late.alias("later")))


def spans(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    if not 0 < k <= length < min(k + 256, 256):
        raise ValueError("k must be from 1 to length, and length 255 at most")
    return seeded_spans(docs, length, lambda w: anchor_seeds(w, length, k), (length - k + 2) / 2, lambda blobs: _extended(blobs, length), id_col, text_col)


def joined(found: DataFrame) -> DataFrame:
    """A row for each document with spans: key, doc_id, spans (those that overlap or meet joined, for either value of later)."""
    rows = found.groupBy("key", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "later"))).alias("s"))

    def run(which: str) -> str:
        """Joins ordered spans, in the JVM."""
        some = f"filter(s, x -> {which})"
        kind = "array<struct<start:bigint,end:bigint>>"
        last = "element_at(a, -1)"
        put = f"case when size(a) > 0 and x.start <= {last}.end then concat(slice(a, 1, size(a) - 1), array(named_struct('start', {last}.start, 'end', greatest({last}.end, x.end)))) else concat(a, array(named_struct('start', x.start, 'end', x.end))) end"
        return f"aggregate({some}, cast(array() as {kind}), (a, x) -> cast({put} as {kind}))"

    return rows.select("key", "doc_id", F.expr(run("true")).alias("repeats"), F.expr(run("x.later")).alias("later"))


def repeats_of(found: DataFrame) -> DataFrame:
    """doc_id, start, length, later of each maximal repeat."""
    each = joined(found).select("doc_id", "later", F.explode("repeats").alias("r"))
    zero = F.lit(0).cast("long")
    inside = F.aggregate("later", zero, lambda a, x: a + F.greatest(zero, F.least(x["end"], F.col("r.end")) - F.greatest(x["start"], F.col("r.start"))))
    return each.select("doc_id", F.col("r.start").alias("start"), (F.col("r.end") - F.col("r.start")).alias("length"), inside.alias("later"))


def maximal_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats of `length` words or more: doc_id, start, length (in words), later (how many of its words lie in stretches that came before).

    Every stretch of `length` words in it occurs once more at least, in another document or elsewhere in
    this one, and it can't be longer on either side. Words are compared without case or punctuation, by 32 bits of
    their hash each. Null, empty and shorter texts have none; very long texts are searched whole; rows without doc_id
    take no part. Repeated rows are one document; rows with one doc_id and different texts are different documents.
    Of equal stretches the first is that of the least doc_id, then of the text's hash, then of the place. Other columns
    are ignored, whatever their names. An empty table gives no rows.
    """
    return repeats_of(spans(docs, length, k, id_col, text_col))


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the given ranges of words, each with what follows its last word."""
    raw = text.encode()
    (_, _, w), *_ = words(pa.array([text], pa.large_string()), fold=False)
    kept, at = [], 0
    for lo, hi in ranges:
        kept.append(raw[at : int(w.start[lo])])
        at = int(w.start[hi]) if hi < len(w.start) else len(raw)
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "replace")


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without passages that came before: the first occurrence of each passage stays (by doc_id, then by place).

    A text that loses all its words goes; a column n_chars follows the text. Other rows are unchanged, those without
    doc_id, with null or empty text, and repeated rows of one document too. All columns stay, whatever their names.
    """
    key, ident, later = unused(docs, "text_key", "text_id", "cut_ranges")
    hit = joined(spans(docs, length, k, id_col, text_col)).where(F.size("later") > 0).select(F.col("key").alias(key), F.col("doc_id").alias(ident), F.col("later").alias(later))
    names = [f"`{c}`" for c in docs.columns]
    keyed = docs.withColumn(key, F.xxhash64(text_col)).withColumn(ident, F.col(id_col).cast("long"))
    # only texts that lose something cross into Python
    base = keyed.join(written(hit), [key, ident], "left")

    @F.pandas_udf("string")
    def shorten(text, ranges):
        import pandas as pd

        return pd.Series([t if r is None else cut(t, [(x["start"], x["end"]) for x in r]) for t, r in zip(text, ranges, strict=True)])

    changed = base.where(F.col(later).isNotNull()).withColumn(text_col, shorten(F.col(text_col), F.col(later))).where(F.length(F.trim(F.col(text_col))) > 0)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return base.where(F.col(later).isNull()).select(*names).unionByName(changed.select(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return maximal_repeats(table(spark, sf_dir, "documents"))
