"""Toxicity by the nearest labelled examples: exact tf-idf cosine over a block-max inverted index.

1. At most EXAMPLES labelled documents of either class are drawn by a hash. The vocabulary is every term of theirs whose
   presence depends on the class beyond chance (chi squared of CHI_SQUARED or more, in LEAST_EXAMPLES of them): over
   all terms, what rare words two texts share by chance drowns what makes them toxic. Document frequencies are counted over all documents.
2. Examples are laid in blocks of BLOCK by their heaviest term. Rare terms have inverted lists. Terms that more
   than one in DENSE examples has are kept as columns of the blocks, with each block's greatest weight of them.
3. Every document is a query. The lists of its rare terms give a lower bound of the cosine with every example,
   and, with the block's greatest weights, an upper bound for every block. Blocks whose bound is below the K-th
   best lower bound are passed over, the others are scored: the K nearest examples are exact.
4. Cosine-weighted votes of the K nearest, made a probability by a logistic curve that is fitted on the
   examples themselves (each without itself and its repeats, weighted to the classes' shares among the labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, table, unpacked
from .textscan import Words, expand, words

EXAMPLES = 6000  # of either class, at most: the bound of the labelled sample
K = 15
LEAST_EXAMPLES, CHI_SQUARED = 4, 15.0
BLOCK = 128
DENSE = 16
ROWS = 256  # queries that are scored at once
EVIDENCE = 3  # nearest examples that are named
SMOOTH = 0.5
THRESHOLD = 0.5


def term_counts(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of the distinct terms of each text."""
    doc = np.repeat(np.arange(w.n), np.diff(w.first))
    order = np.lexsort((w.hash, doc))
    d, h = doc[order], w.hash[order]
    head = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])))) if len(d) else np.zeros(0, np.int64)
    return d[head], h[head], np.diff(np.append(head, len(d)))


def vocabulary(terms: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Terms (in order) that tell the classes apart, by chi squared of their presence."""
    if not len(terms) or toxic.all() or not toxic.any():
        return np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    value, back = np.unique(np.concatenate(terms), return_inverse=True)
    bad = np.bincount(back, toxic[of], minlength=len(value))
    all_of = np.bincount(back, minlength=len(value)).astype(float)
    n, n_bad = len(terms), toxic.sum()
    a, b, c, d = bad, all_of - bad, n_bad - bad, (n - n_bad) - (all_of - bad)
    chi = n * (a * d - b * c) ** 2 / np.maximum(1e-9, (a + b) * (c + d) * (a + c) * (b + d))
    return value[(all_of >= LEAST_EXAMPLES) & (chi >= CHI_SQUARED)]


class Index:
    """Examples as unit vectors, (example, term, weight) in order of example: inverted lists of rare terms, and blocks of frequent ones."""

    def __init__(self, of: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, labels: np.ndarray, ids: np.ndarray, group: np.ndarray | None = None):
        n = len(labels)
        some = np.zeros(n, bool)
        some[of] = True
        heaviest = np.full(n, terms)
        order = np.lexsort((term, -weight, of))
        lead = np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1]))) if len(of) else order
        heaviest[of[order][lead]] = term[order][lead]
        place = np.flatnonzero(some)
        place = place[np.lexsort((ids[place], heaviest[place]))]
        new = np.full(n, -1)
        new[place] = np.arange(len(place))
        of = new[of]
        self.n, self.blocks = len(place), -(-len(place) // BLOCK)
        self.labels, self.ids = labels[place].astype(np.float32), ids[place]
        self.group = np.arange(self.n) if group is None else group[place]
        self.rank = np.empty(self.n, np.int64)
        self.rank[np.lexsort((np.arange(self.n), self.ids))] = np.arange(self.n)
        length = np.bincount(term, minlength=terms)
        frequent = np.flatnonzero(length > self.n / DENSE)
        self.column = np.full(terms, -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        dense = self.column[term] >= 0
        self.wide = np.zeros((len(frequent), self.blocks * BLOCK), np.float32)
        self.wide[self.column[term[dense]], of[dense]] = weight[dense]
        self.most = self.wide.reshape(len(frequent), self.blocks, BLOCK).max(axis=2) if self.blocks else np.zeros((len(frequent), 0), np.float32)
        order = np.argsort(term[~dense], kind="stable")
        self.first = np.concatenate(([0], np.cumsum(np.bincount(term[~dense], minlength=terms))))
        self.list, self.weight = of[~dense][order].astype(np.int32), weight[~dense][order].astype(np.float32)
        self.scored = 0  # (query, block) pairs looked into

    def nearest(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest of n queries, (query, term, weight) in order of query, best first, ties by id; -1 for none. own: of each query, a group of examples that is left out."""
        k = min(k, self.n)
        who, best = np.full((n, k), -1, np.int64), np.zeros((n, k), np.float32)
        if not k:
            return who, best
        edge = np.searchsorted(query, np.arange(0, n + ROWS, ROWS))
        for b, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            at = slice(b * ROWS, min(n, (b + 1) * ROWS))
            if hi > lo:
                who[at], best[at] = self._nearest(query[lo:hi] - b * ROWS, term[lo:hi], weight[lo:hi], at.stop - at.start, k, None if own is None else own[at])
        return who, best

    def _nearest(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        width = self.blocks * BLOCK
        owner, j = expand(self.first[term + 1] - self.first[term])
        at = self.first[term][owner] + j
        score = np.bincount(query[owner] * width + self.list[at], weight[owner] * self.weight[at], minlength=n * width).reshape(n, width)
        if own is not None:
            score[:, : self.n][self.group[None] == own[:, None]] = -4
        dense = self.column[term] >= 0
        q = np.zeros((n, len(self.most)), np.float32)
        q[query[dense], self.column[term[dense]]] = weight[dense]
        least = np.partition(score[:, : self.n], self.n - k, axis=1)[:, self.n - k]
        bound = score.reshape(n, self.blocks, BLOCK).max(axis=2) + q @ self.most
        look = (bound >= least[:, None] - 2e-6) & (bound > 0)
        total = np.full((n, width), -4.0)
        for b in np.flatnonzero(look.any(axis=0)).tolist():
            rows, block = np.flatnonzero(look[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
            total[rows, block] = score[rows, block] + q[rows] @ self.wide[:, block]
            self.scored += len(rows)
        total = total[:, : self.n]
        # cosines that differ by rounding alone are ties, and go to the lesser id
        key = np.round(total, 6) - self.rank * 1e-11
        top = np.argpartition(-key, k - 1, axis=1)[:, :k] if k < self.n else np.broadcast_to(np.arange(self.n), (n, self.n))
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1, kind="stable"), 1)
        cosine = np.take_along_axis(total, top, 1)
        found = cosine > 1e-9
        return np.where(found, top, -1), np.where(found, cosine, 0).astype(np.float32)

    def votes(self, who: np.ndarray, sims: np.ndarray) -> np.ndarray:
        if not who.shape[1]:
            return np.zeros(len(who))
        y = np.where(who >= 0, self.labels[np.maximum(who, 0)], 0) if self.n else 0 * sims
        return (sims * y).sum(1) / (sims.sum(1) + SMOOTH)


def calibrate(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps with a light ridge."""
    a, b = 1.0, 0.0
    w = weight / max(1e-9, weight.sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * votes + b, -40, 40)))
        g = np.array([(w * (p - toxic) * votes).sum() + 1e-4 * a, (w * (p - toxic)).sum() + 1e-6 * b])
        c = w * p * (1 - p)
        h = np.array([[(c * votes**2).sum() + 1e-4, (c * votes).sum()], [(c * votes).sum(), c.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    """Vocabulary, idf, index of examples, and the calibration."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, index: Index | None, curve: tuple[float, float]):
        self.terms, self.idf, self.index, self.curve = terms, idf, index, curve

    def vectors(self, doc: np.ndarray, term: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in the vocabulary, weight) of unit tf-idf rows over the vocabulary."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        doc, at = doc[hit], at[hit]
        x = (1 + np.log(times[hit])) * self.idf[at]
        if len(x):
            x /= np.maximum(1e-9, np.sqrt(np.bincount(doc, x * x)))[doc]
        return doc, at, x.astype(np.float32)

    def probability(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * votes + self.curve[1], -40, 40)))


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    u = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    # a few more than are wanted, of which the first by u stay
    rate = F.create_map(*[F.lit(x) for y in (0, 1) for x in (y, int(min(1.0, (1.1 * examples + 50) / max(1, counts.get(y, 0))) * (1 << 30)))])
    drawn = known.withColumn("u", u).where(F.col("u") < F.element_at(rate, F.col("y")))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # repeated rows are one example
    chosen = base.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id", "text"]).select("doc_id", "y", "text", "u")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in words(batch.column(2)):
                d, h, n = term_counts(w)
                first = np.searchsorted(d, np.arange(j - i + 1))
                blobs = [packed(h[lo:hi], n[lo:hi].astype("i4")) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in (0, 1, 3)], pa.array(blobs, pa.binary())], names=["doc_id", "y", "u", "terms"])

    got = chosen.mapInArrow(scan, "doc_id long, y int, u long, terms binary").toArrow()  # the bounded sample, on the driver
    blobs, ids, toxic, u = got.column("terms").to_pylist(), got.column("doc_id").to_numpy(), got.column("y").to_numpy(), got.column("u").to_numpy()
    order = sorted(range(len(blobs)), key=lambda i: (u[i], ids[i], blobs[i]))
    order = [i for y in (0, 1) for i in [i for i in order if toxic[i] == y][:examples]]
    columns = [unpacked([blobs[i]], ("u8", "i4")) for i in order]
    # repeats of an example, by id or by text, are of its group
    group = _groups(ids[order], [hash(blobs[i]) for i in order])
    ids, toxic = ids[order], toxic[order].astype(float)
    terms = vocabulary([c[0] for c in columns], toxic)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, w in words(batch.column(0)):
                at = np.minimum(np.searchsorted(terms, w.hash), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == w.hash)
                doc = np.searchsorted(w.first, hit, side="right") - 1
                df += np.bincount(np.unique(doc * len(terms) + at[hit]) % len(terms), minlength=len(terms))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(some, -1), pa.int32()), "n": pa.array(np.append(df[some], n), pa.int64())})

    df = np.zeros(len(terms) + 1)
    if len(terms):
        counted = base.select("text").mapInArrow(frequency, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the examples
        df[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    idf = np.log((df[-1] + 1) / (df[:-1] + 0.5)).clip(min=0.05).astype(np.float32)
    model = Model(terms, idf, None, (1.0, -20.0))
    doc = np.repeat(np.arange(len(columns)), [len(c[0]) for c in columns])
    x = model.vectors(doc, *[np.concatenate([np.zeros(0, k), *[c[j] for c in columns]]) for j, k in ((0, np.uint64), (1, np.int32))])
    model.index = Index(*x, len(terms), toxic, ids, group)
    if not len(terms):
        return model
    votes = model.index.votes(*model.index.nearest(*x, len(columns), K, group))
    share = [counts.get(y, 0) / max(1.0, (toxic == y).sum()) for y in (0, 1)]
    model.curve = calibrate(votes, toxic, np.where(toxic == 1, share[1], share[0]))
    return model


def _groups(ids: np.ndarray, marks: list[int]) -> np.ndarray:
    """The first row that each row shares its id or its mark with, or a row that does so with it."""
    group = np.arange(len(ids))
    for keys in (ids.tolist(), marks) * 2:
        first: dict = {}
        for i, k in enumerate(keys):
            group[i] = first.setdefault(k, group[i])
    return group


def rate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, score (probability of toxic), toxic (score at the threshold or above), evidence (ids of the nearest examples), similar (their cosines).

    A text that is null, empty or without any term of the vocabulary has no neighbours: its evidence is
    empty, and its score is that of no votes. So are all where the labels hold one class only. A null
    doc_id stays null. Labels that are null or for unknown documents aren't used; a doc_id with two labels
    is toxic if one of them says so. Very long texts are compared whole. Repeated rows are rated each time and alike.
    Ties go to the lesser id. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by EXAMPLES

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for i, j, w in words(batch.column(1)):
                n = j - i
                votes = np.zeros(n)
                evidence: list[list[int]] = [[] for _ in range(n)]
                similar: list[list[float]] = [[] for _ in range(n)]
                if len(model.terms):
                    who, sims = model.index.nearest(*model.vectors(*term_counts(w)), n, K)
                    votes = model.index.votes(who, sims)
                    for r, (ids, s) in enumerate(zip(who[:, :EVIDENCE].tolist(), sims[:, :EVIDENCE].tolist(), strict=True)):
                        evidence[r] = [int(model.index.ids[e]) for e in ids if e >= 0]
                        similar[r] = [float(v) for e, v in zip(ids, s, strict=True) if e >= 0]
                p = model.probability(np.asarray(votes, np.float64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(p), pa.array(p >= threshold), pa.array(evidence, pa.list_(pa.int64())), pa.array(similar, pa.list_(pa.float64()))],
                    names=["doc_id", "score", "toxic", "evidence", "similar"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(score, "doc_id long, score double, toxic boolean, evidence array<long>, similar array<double>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rate(docs, train(docs, table(spark, sf_dir, "labels")))
