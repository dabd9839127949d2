"""Suffix-array dedup by prefix-free parsing, on words.

A rolling hash of TRIGGER words that is 0 modulo MODULUS ends a phrase and begins the next one, so phrases
depend on the words about them alone, and equal passages are parsed alike wherever they occur. The distinct
phrases are the dictionary; documents are sequences of phrases, the parse. No phrase's suffix that is longer
than a trigger is a prefix of another's.

A suffix of the corpus is the suffix of a phrase and then a suffix of the parse. So corpus order is had from
two arrays, without comparing suffixes of the corpus: the dictionary's suffixes in order, and the parse's
suffixes in order with the longest common prefix of neighbours; where several occurrences have one suffix of
a phrase, their order is that of the parse. Neighbours in corpus order share the suffix of a phrase and the
least of the common prefixes between them in the parse, and where that is LENGTH words or more, both are repeats.

Stretches of LENGTH words are filed by the first whole phrase in them, and those without a whole phrase by the
one trigger in them, or by all of their words. Phrases that occur once are dropped first, by a table of bits.
A phrase goes to one task with its dictionary, the distinct phrases before it, and with its part of the parse,
what follows it to the depth of LENGTH words: that is all that dedup needs, and deeper suffixes are ties. What
a mapper meets again is sent once, so highly repetitive text moves little. Each task has its suffixes in corpus
order; there is no need to bring tasks into one order. Phrases of more than HOT occurrences are joined by
fingerprints of their stretches, as in `repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import shared_dir, table
from .repeats import Occurrences, Seeds, _spans, merge, repeats_of, seeded_spans
from .textscan import Words, expand, mix, rolling, spans_hash

LENGTH = 50
TRIGGER, MODULUS = 4, 16
_SALTS = (np.uint64(0x51), np.uint64(0x52), np.uint64(0x53))


def parse(w: Words, trigger: int, modulus: int) -> np.ndarray:
    """First word of each trigger, in order; a trigger lies within one text."""
    h = rolling(w.hash, trigger)
    at = np.flatnonzero(mix(h) % np.uint64(modulus) == 0)
    text_of = np.searchsorted(w.first, at, side="right") - 1
    return at[at + trigger <= w.first[text_of + 1]]


def filed(w: Words, length: int, trigger: int, modulus: int) -> tuple[np.ndarray, ...]:
    """(first word, text, name and first word of the phrase that it is filed by) of every stretch of `length` words within a text."""
    count = np.diff(w.first)
    text = np.repeat(np.arange(w.n), count)
    begin = np.flatnonzero(w.first[text + 1] - np.arange(len(text)) >= length) if len(text) else text
    text = text[begin]
    at = parse(w, trigger, modulus)
    ends = np.append(at, len(w.hash) + length)  # no trigger
    k = np.searchsorted(at, begin)
    one, two = ends[k], ends[np.minimum(k + 1, len(at))]
    last = begin + length
    has_two, has_one = two + trigger <= last, one + trigger <= last
    name = np.empty(len(begin), np.uint64)
    name[has_two] = mix(spans_hash(w.hash, one[has_two], two[has_two] + trigger) ^ _SALTS[0])
    single = has_one & ~has_two
    name[single] = mix(spans_hash(w.hash, one[single], one[single] + trigger) ^ _SALTS[1])
    name[~has_one] = mix(spans_hash(w.hash, begin[~has_one], last[~has_one]) ^ _SALTS[2])
    # a stretch without a trigger is a phrase of its own, and its last words stand for the trigger
    return begin, text, name, np.where(has_one, one, last - trigger)


def phrase_seeds(w: Words, length: int, trigger: int, modulus: int) -> Seeds:
    begin, text, name, at = filed(w, length, trigger, modulus)
    if not len(begin):
        return text, begin, at, name, begin
    lead = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (name[1:] != name[:-1]) | (text[1:] != text[:-1]))))
    return text[lead], begin[lead], at[lead], name[lead], np.diff(np.append(lead, len(begin)))


def _joint(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks, in order."""
    return np.unique((one.astype(np.uint64) << np.uint64(32)) | two.astype(np.uint64), return_inverse=True)[1]


def sorted_rows(rows: np.ndarray) -> np.ndarray:
    """The rank of each row among the distinct rows in order, by ranks of halves that are joined."""
    columns = [rows[:, k] for k in range(rows.shape[1])]
    while len(columns) > 1:
        columns = [_joint(columns[k], columns[k + 1]) if k + 1 < len(columns) else columns[k] for k in range(0, len(columns), 2)]
    return np.unique(columns[0], return_inverse=True)[1]


def suffix_ranks(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The rank of each suffix of each string (first[i] : first[i + 1] of `text`), equal ones alike, by prefix doubling; a string's end comes before any word."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    end = np.repeat(first[1:], np.diff(first))
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    step, longest = 1, int(np.diff(first).max())
    while step < longest:
        then = np.arange(n) + step
        rank = _joint(rank, np.where(then < end, rank[np.minimum(then, n - 1)], 0)) + 1
        step *= 2
    return rank


class CorpusOrder:
    """Suffixes of a part in corpus order: seed of[i], tail[i] words before its phrase begins, and common[i], the longest common prefix with the one before, to the depth of `length`."""

    def __init__(self, o: Occurrences, length: int, trigger: int):
        m = len(o.name)
        at = o.first + o.left
        # the parse: what follows, in order; places beyond a context are 0
        follows = (length - (o.left - o.n + 1))[:, None] > np.arange(length)
        rows = np.where(follows, o.words[np.minimum(at[:, None] + np.arange(length), len(o.words) - 1)].astype(np.int64) + 1, 0)
        rank = sorted_rows(rows)
        order = np.argsort(rank, kind="stable")
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        differ = rows[order][1:] != rows[order][:-1]
        common = np.where(differ.any(1), differ.argmax(1), length)
        self._levels = [common.astype(np.int16)]
        while 2 << len(self._levels) - 1 <= len(common):
            step = 1 << len(self._levels) - 1
            self._levels.append(np.minimum(self._levels[-1][:-step], self._levels[-1][step:]))
        # the dictionary: the phrase before, with the trigger that ends it
        size = o.left + trigger
        owner, k = expand(size)
        text = o.words[np.minimum(o.first[owner] + k, len(o.words) - 1)].astype(np.int64) + 1
        first = np.concatenate(([0], np.cumsum(size)))
        mark = mix(spans_hash(text.astype(np.uint64), first[:-1], first[1:]))
        _, lead, back = np.unique(mark, return_index=True, return_inverse=True)
        words_of, j = expand(size[lead])
        d_first = np.concatenate(([0], np.cumsum(size[lead])))
        suffix = suffix_ranks(text[first[lead][words_of] + j], d_first)
        # all suffixes: those of stretches that are filed by the seed
        of, k = expand(o.n)
        tail = o.left[of] - k
        by_phrase = suffix[d_first[back[of]] + k]
        order = np.lexsort((place[of], by_phrase))
        self.of, self.tail = of[order], tail[order]
        here = by_phrase[order]
        low, high = place[self.of][:-1], place[self.of][1:]
        same = (here[1:] == here[:-1]) & (self.tail[1:] == self.tail[:-1])
        self.common = np.zeros(len(order), np.int64)
        self.common[1:][same] = self.tail[1:][same] + self._least(low[same], high[same])
        self.common = np.minimum(self.common, length)

    def _least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Common prefix of the parse's suffixes at places low and high: the least between neighbours from the one to the other."""
        out = np.empty(len(low), np.int64)
        level = np.log2(high - low).astype(np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self._levels[k][low[at]], self._levels[k][high[at] - (1 << k)])
        return out


def _ordered(blobs: Iterator[bytes], length: int, trigger: int) -> pa.Table:
    """Spans of repeats among the suffixes that are filed in this part."""
    o = Occurrences(blobs, length)
    none = np.zeros(0, np.int64)
    if not len(o.name):
        return _spans(none, none, none, none, none.astype(bool))
    s = CorpusOrder(o, length, trigger)
    head = s.common < length  # a run of suffixes that agree to the depth begins
    run = np.cumsum(head) - 1
    repeated = np.bincount(run)[run] > 1
    earliest = np.minimum.reduceat(s.of, np.flatnonzero(head))[run]  # occurrences are in order of document
    of, e, tail = s.of[repeated], earliest[repeated], s.tail[repeated]
    if not len(of):
        return _spans(none, none, none, none, none.astype(bool))
    elsewhere = (o.doc[of] != o.doc[e]) | (o.key[of] != o.key[e])
    late = (of != e) & (elsewhere | (o.pos[of] - o.pos[e] >= length))
    start = o.pos[of] - tail
    return _spans(*merge(o.key[of], o.doc[of], start, start + length, late))


def spans(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, modulus: int = MODULUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, start, end, later), as in the seed-and-extend operator, whose repeats these are too."""
    if not 0 < trigger <= length < 256:
        raise ValueError("length must be from trigger to 255")
    return seeded_spans(docs, length, lambda w: phrase_seeds(w, length, trigger, modulus), modulus, lambda blobs: _ordered(blobs, length, trigger), id_col, text_col)


def repeated_passages(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, modulus: int = MODULUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats of `length` words or more: doc_id, start, length (in words), later (how many of its words lie in stretches that came before).

    Every stretch of `length` words in it occurs once more at least. Words are compared without case or
    punctuation, by 32 bits of their hash each. Null, empty and shorter texts have none; very long texts are searched
    whole; rows without doc_id take no part. Repeated rows are one document; rows with one doc_id and different texts
    are different documents. Of equal stretches the first is that of the least doc_id, then of the text's hash, then of
    the place. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    return repeats_of(spans(docs, length, trigger, modulus, id_col, text_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return repeated_passages(table(spark, sf_dir, "documents"))
