"""Weak-label quality model: heuristic labellers, expectation-maximisation, and a hashed linear scorer.

1. Eight overlapping labellers vote good (+1), bad (-1) or abstain (0) on every document.
2. Votes are counted by pattern over all documents; there are at most 3^8 patterns, whatever the input.
   Expectation-maximisation over the counts estimates how each labeller votes on good and on bad
   documents, and from that each pattern's posterior probability of a good document.
3. Posterior labels of a bounded sample train a logistic scorer on hashed features: byte trigrams, and
   the labellers' measures in buckets. The scorer then rates every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textscan import chunks, expand, letters, scan

LABELLERS = ("symbols", "shouting", "marks", "tables", "stutter", "variety", "sentences", "word_length")
BUCKETS = 1 << 16
SAMPLE = 8000  # documents that the scorer is trained on, half of them of either posterior label
THRESHOLD = 0.5
FALSE_ALARMS = 0.005  # prior: a labeller votes bad on at most this share of good documents
_BASE = 3 ** np.arange(len(LABELLERS))


def _of(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _MARK, _PIPE, _STOP = _of("#$%&*@^~<>{}[]\\=+_"), _of("!?"), _of("|\t"), _of(".!?:;")
_LOWER = {ord("A") + i: ord("a") + i for i in range(26)}
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[list(_LOWER)] = list(_LOWER.values())


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return (total[offs[1:]] - total[offs[:-1]]).astype(float)


def measures(offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The labellers' measures, a row for each text; a text without words has zeros but for its last column, its number of words."""
    w = scan(offs, _TO_LOWER[data])
    n = np.diff(w.first).astype(float)
    size = np.maximum(1, np.diff(offs))
    words = np.maximum(1, n)
    doc = np.repeat(np.arange(w.n), np.diff(w.first))
    again = np.zeros(len(doc), dtype=bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    # distinct words among the words of each run of 256: long texts aren't marked down for being long
    run = (np.arange(len(doc)) - w.first[doc]) // 256
    of_run = np.unique(w.hash ^ ((doc.astype(np.uint64) << np.uint64(20)) + run.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
    upper = ((data >= 65) & (data <= 90)) | np.concatenate(([False], (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)))[: len(data)]
    lead = letters(data) & ((data & 0xC0) != 0x80)
    return np.column_stack(
        [
            _sums(_SYMBOL[data], offs) / words,
            _sums(upper, offs) / np.maximum(1, _sums(lead, offs)),
            _sums(_MARK[data], offs) / words,
            _sums(_PIPE[data], offs) / words,
            _sums(again, w.first) / words,
            np.bincount(doc[of_run], minlength=w.n) / words,
            _sums(_STOP[data], offs) / words,
            _sums(lead, offs) / words,
            n,
        ]
    ) * (n > 0)[:, None]


def votes(m: np.ndarray) -> np.ndarray:
    """+1, 0 or -1 of each labeller, a row for each text."""
    symbols, shouting, marks, pipes, stutter, variety, stops, length, n = m.T

    def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, -1, np.where(good, 1, 0))

    some, many = n > 0, n >= 20
    return np.column_stack(
        [
            vote(some & (symbols < 0.05), symbols > 0.2),
            vote(some & (shouting < 0.2), many & (shouting > 0.6)),
            vote(some & (marks < 0.1), marks > 0.4),
            vote(some & (pipes < 0.02), pipes > 0.2),
            vote(many & (stutter < 0.05), (n >= 4) & (stutter > 0.3)),
            vote(many & (variety > 0.35), many & (variety < 0.15)),
            vote(many & (stops > 0.02) & (stops < 0.3), many & ((stops < 0.004) | (stops > 0.7))),
            vote(many & (length > 2.5) & (length < 9), (n > 0) & ((length > 20) | (many & (length < 1.5)))),
        ]
    )


def pattern(v: np.ndarray) -> np.ndarray:
    return (v + 1) @ _BASE


def unpattern(p: np.ndarray) -> np.ndarray:
    return (np.asarray(p)[:, None] // _BASE) % 3 - 1


def estimate(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Posterior probability of a good document for each vote pattern, by expectation-maximisation.

    There are one good class and as many bad ones as labellers, as documents are bad in different ways:
    with a single bad class, a defect that one labeller sees is outvoted by those that can't see it. Votes
    are independent given the class, and an abstention says nothing. The start holds a document with bad
    votes for bad in those labellers' ways; labellers' false alarms on good documents are bounded by prior."""
    if not counts:
        return {}
    keys = sorted(counts)
    v, n = unpattern(np.array(keys)), np.array([counts[k] for k in keys], dtype=float)
    bad = v == -1
    p = np.full((len(keys), 1 + v.shape[1]), 1e-3)
    p[:, 0] = np.where(bad.any(1), 0.05, np.where((v == 1).any(1), 0.95, 0.5))
    p[:, 1:] += bad / np.maximum(1, bad.sum(1))[:, None]
    p /= p.sum(1, keepdims=True)
    for _ in range(rounds):
        weight = n[:, None] * p
        odds = np.tile(np.log((weight.sum(0) + 1e-3) / n.sum()), (len(keys), 1))
        for j in range(v.shape[1]):
            voted = v[:, j] != 0
            no = (weight[bad[:, j]].sum(0) + 0.5) / (weight[voted].sum(0) + 1)
            no[0] = min(no[0], FALSE_ALARMS)
            odds[voted] += np.where(bad[voted, j][:, None], np.log(no), np.log(1 - no))
        q = np.exp(odds - odds.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        moved = np.abs(q - p).max()
        p = q
        if moved < 1e-9:
            break
    return dict(zip(keys, p[:, 0].tolist(), strict=True))


_STEPS = (0.004, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.5, 2.5, 4, 6, 9, 20)


def _grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at each byte but the last two."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    b = data.astype(np.uint32)
    return (((b[:-2] | (b[1:-1] << 8) | (b[2:] << 16)) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _shape(m: np.ndarray) -> np.ndarray:
    """Buckets of the measures: a column for each."""
    k = np.searchsorted(_STEPS, m[:, :-1])
    k = np.column_stack([k, np.minimum(15, np.log2(m[:, -1] + 1).astype(int))]).astype(np.uint32)
    return ((((k + 1) * np.uint32(40503) + np.arange(k.shape[1], dtype=np.uint32) * np.uint32(7919)) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _scores(offs: np.ndarray, data: np.ndarray, m: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    at = _grams(data)
    total = np.concatenate(([0.0], np.cumsum(weights[at], dtype=np.float64)))
    lo, hi = np.minimum(offs[:-1], len(at)), np.clip(offs[1:] - 2, 0, len(at))
    hi = np.maximum(lo, hi)
    mean = (total[hi] - total[lo]) / np.maximum(1, hi - lo)
    return 1 / (1 + np.exp(-np.clip(bias + mean * np.sqrt(50) + weights[_shape(m)].sum(1), -50, 50)))


def fit(texts: pa.Array, target: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic scorer for texts with target probabilities."""
    weights, bias = np.zeros(BUCKETS, dtype=np.float64), 0.0
    n = len(texts)
    if not n:
        return weights.astype(np.float32), bias
    rows, cols, vals = [], [], []
    for i, _, offs, data in chunks(texts):
        at, m = _grams(data), _shape(measures(offs, data))
        lo, hi = np.minimum(offs[:-1], len(at)), np.clip(offs[1:] - 2, 0, len(at))
        hi = np.maximum(lo, hi)
        owner, k = expand(hi - lo)
        key, c = np.unique(owner * BUCKETS + at[lo[owner] + k], return_counts=True)
        rows += [i + key // BUCKETS, i + np.repeat(np.arange(len(m)), m.shape[1])]
        cols += [key % BUCKETS, m.ravel()]
        vals += [c / np.maximum(1, hi - lo)[key // BUCKETS] * np.sqrt(50), np.ones(m.size)]
    row, col, val = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals).astype(np.float32)
    del rows, cols, vals
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    each = np.where(target >= 0.5, 0.5 / share, 0.5 / (1 - share))  # the classes weigh alike
    step, seen, seen_bias = 0.5, np.full(BUCKETS, 1e-6), 1e-6
    for _ in range(rounds):  # AdaGrad on the whole sample
        z = np.bincount(row, val * weights[col], minlength=n) + bias
        error = each * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / n
        g = np.bincount(col, val * error[row], minlength=BUCKETS) + 1e-5 * weights
        seen += g * g
        seen_bias += error.sum() ** 2
        weights -= step * g / np.sqrt(seen)
        bias -= step * error.sum() / np.sqrt(seen_bias)
    return weights.astype(np.float32), float(bias)


def _texts(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Model:
    """Posteriors by pattern, and the scorer's weights."""

    def __init__(self, posterior: dict[int, float], weights: np.ndarray, bias: float, threshold: float = THRESHOLD):
        self.posterior, self.weights, self.bias, self.threshold = posterior, weights, bias, threshold

    def rate(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of the votes, scorer's probability of a good document) of each text."""
        weak, score = [np.zeros(0)], [np.zeros(0)]
        for _, _, offs, data in chunks(texts):
            m = measures(offs, data)
            kinds, back = np.unique(pattern(votes(m)), return_inverse=True)
            weak.append(np.array([self.posterior.get(int(k), 0.5) for k in kinds])[back])
            score.append(_scores(offs, data, m, self.weights, self.bias))
        return np.concatenate(weak), np.concatenate(score)


def train(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Votes are counted over all documents; the scorer is fitted on at most `sample` of them (drawn by a hash of id and text)."""
    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for _, _, offs, data in chunks(batch.column(0)):
                for k, c in zip(*np.unique(pattern(votes(measures(offs, data))), return_counts=True), strict=True):
                    total[int(k)] = total.get(int(k), 0) + int(c)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    counted = text.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    counts = {r["pattern"]: r["n"] for r in counted.collect()}  # at most 3^8 rows
    posterior = estimate(counts)
    good = sum(n for k, n in counts.items() if posterior[k] >= 0.5)
    bad = sum(counts.values()) - good
    rates = tuple(min(1.0, sample / 2 / max(1, n)) for n in (bad, good))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [np.zeros(0)]
            for _, _, offs, data in chunks(batch.column(0)):
                kinds, back = np.unique(pattern(votes(measures(offs, data))), return_inverse=True)
                p.append(np.array([posterior.get(int(k), 0.5) for k in kinds])[back])
            p = np.concatenate(p)
            keep = batch.column(1).to_numpy(zero_copy_only=False) < np.where(p >= 0.5, rates[1], rates[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(p[keep])], names=["text", "p"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        all_of = pa.Table.from_batches(got).sort_by("text")
        w, b = fit(_texts(all_of["text"]), all_of["p"].to_numpy())
        yield pa.RecordBatch.from_pydict({"w": pa.array([w.tobytes()], pa.binary()), "b": [b]})

    u = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    drawn = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), u.alias("u")).where(F.col("u") < max(rates)).mapInArrow(draw, "text string, p double")
    row = drawn.repartition(1).mapInArrow(learn, "w binary, b double").collect()
    weights = np.frombuffer(row[0]["w"], dtype=np.float32) if row else np.zeros(BUCKETS, dtype=np.float32)
    return Model(posterior, weights, row[0]["b"] if row else 0.0, threshold)


def classify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, weak (posterior of the labellers' votes), score (of the scorer), keep.

    Null and empty texts have no words: every labeller abstains, and they are rated by the scorer like
    any other text. Very long texts are measured whole. A null doc_id stays null. Repeated rows are rated each time and
    alike; a score that ties with the threshold is kept. Other columns are ignored, whatever their names. An empty table
    gives no rows.
    """
    model = model or train(docs, id_col=id_col, text_col=text_col)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weak, score = model.rate(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak), pa.array(score), pa.array(score >= model.threshold)], names=["doc_id", "weak", "score", "keep"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(rate, "doc_id long, weak double, score double, keep boolean")


def keep_good(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the scorer rates at the threshold or above, with all their columns, whatever their names. Edge cases are those of `classify`."""
    model = model or train(docs, id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.rate(batch.column(at))[1] >= model.threshold)).rename_columns(docs_columns)

    docs_columns = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(docs_columns))]).mapInArrow(kept, docs.schema)  # names may hold dots


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
