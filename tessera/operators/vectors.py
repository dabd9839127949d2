"""Vector search: exact by expressions in the JVM, clustered (inverted file) and product-quantised by Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFound
from ..session import last_of

METRICS = ("cosine", "dot", "l2")
BLOCK = 50_000  # queries that every task holds at once, about
_SCORES = 1_000_000  # that a task holds, at 16 bytes each
TRAIN_MOST = 100_000  # rows that centroids are trained on, about


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _norm(a: Column) -> Column:
    n = F.sqrt(_dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def score(vector: Column, query: Sequence[float] | Column, metric: str = "cosine") -> Column:
    """cosine and dot: similarity; l2: distance."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    if metric == "dot":
        return _dot(vector, q)
    if isinstance(query, Column):
        return _dot(vector, q) / (_norm(vector) * _norm(q))
    n = float(np.linalg.norm(np.asarray(query, float))) or 1.0
    return _dot(vector, F.array(*[F.lit(float(x) / n) for x in query])) / _norm(vector)


def flat_search(df: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vec") -> DataFrame:
    """(id, score), best first; l2 scores are negative squared distances."""
    s = score(F.col(vector_col), query, metric)
    return df.select(F.col(id_col).alias("id"), (-s * s if metric == "l2" else s).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def _nearest(q: np.ndarray, who: Sequence[int], x: np.ndarray, k: int, metric: str, most: int) -> Iterator[tuple[Sequence[int], np.ndarray, np.ndarray]]:
    """(queries, places of their k nearest rows of x, scores) for the queries `who`, in runs of `most` scores, so memory doesn't grow with their number."""
    step = max(1, most // len(x))
    for at in range(0, len(who), step):
        some = who[at : at + step]
        s = q[some] @ x.T
        if metric == "l2":
            s *= 2
            s -= (x * x).sum(1)[None]
            s -= (q[some] * q[some]).sum(1)[:, None]
        np.negative(s, out=s)
        top = np.argpartition(s, min(k, s.shape[1]) - 1, axis=1)[:, :k].copy()
        yield some, top, -np.take_along_axis(s, top, 1)


def batch_search(df: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vec") -> DataFrame:
    """(query_id, id, score): the k nearest for many queries. Each Arrow batch of vectors is multiplied with all queries and keeps its k best, so a scan serves a block of queries and k rows a batch and query are shuffled."""
    blocks = -(-queries.count() // BLOCK)
    if blocks > 1:
        some = [queries.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b) for b in range(blocks)]
        return reduce(DataFrame.unionAll, [_batch_search(df, x, k, metric, id_col, vector_col) for x in some])
    return _batch_search(df, queries, k, metric, id_col, vector_col)


def _batch_search(df: DataFrame, queries: DataFrame, k: int, metric: str, id_col: str, vector_col: str) -> DataFrame:
    got = queries.select(F.col(id_col), F.col(vector_col)).toArrow()
    qid = got.column(0).to_numpy()
    q = np.stack(got.column(1).to_numpy(zero_copy_only=False)).astype(np.float32) if len(qid) else np.zeros((0, 1), np.float32)

    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1, n) if metric == "cosine" else x

    sent = df.sparkSession.sparkContext.broadcast((qid, unit(q)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = sent.value
        for batch in batches:
            if not batch.num_rows or not len(qid):
                continue
            ids = batch.column(0).to_numpy()
            x = unit(np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float32))
            for some, top, s in _nearest(q, np.arange(len(q)), x, k, metric, _SCORES):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid[some], top.shape[1])), pa.array(ids[top].ravel()), pa.array(s.ravel().astype(float))], names=["query_id", "id", "score"])

    return _best_of(df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col)).mapInArrow(best, "query_id long, id long, score double"), k)


def _best_of(near: DataFrame, k: int) -> DataFrame:
    """The k best of each query."""
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k)
    return near.groupBy("query_id").agg(ordered.alias("t")).select("query_id", F.explode("t").alias("x")).select("query_id", "x.id", (-F.col("x.s")).alias("score"))


def _without(df: DataFrame, ids: Sequence[int]) -> DataFrame:
    """df without the ids; one that isn't there is an error."""
    asked = df.sparkSession.createDataFrame([(i,) for i in ids], "id long").distinct()
    if bad := asked.join(df, "id", "left_anti").limit(1).collect():
        raise NotFound(bad[0][0])
    return df.join(asked, "id", "left_anti").select(*df.columns)


@dataclass(frozen=True)
class FlatIndex:
    """(id, vec), searched exactly; for cosine vectors are brought to length 1 as they come in."""

    df: DataFrame
    dim: int
    metric: str = "cosine"

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(self.metric)

    @classmethod
    def empty(cls, spark: SparkSession, dim: int, metric: str = "cosine") -> FlatIndex:
        return cls(spark.createDataFrame([], "id long, vec array<double>"), dim, metric)

    def add_many(self, df: DataFrame, id_col: str = "id", vector_col: str = "vec", order: str | None = None) -> FlatIndex:
        """Vectors put in or put over; of one id the last by `order`, or else by place, wins."""
        v = F.col(vector_col).cast("array<double>")
        fits = F.when(F.size(v) == self.dim, v).otherwise(F.raise_error(F.lit(f"not {self.dim} numbers")).cast("array<double>"))
        new = df.select(F.col(id_col).cast("long").alias("id"), fits.alias("vec"), *([F.col(order).alias("__order")] if order else []))
        new = last_of(new, ["id"], "__order" if order else None)
        if self.metric == "cosine":
            new = new.withColumn("vec", F.transform("vec", lambda x: x / _norm(F.col("vec"))))
        return replace(self, df=self.df.join(new.select("id"), "id", "left_anti").unionByName(new.select("id", "vec")))

    def remove(self, ids: Sequence[int]) -> FlatIndex:
        return replace(self, df=_without(self.df, ids))

    def __len__(self) -> int:
        return self.df.count()

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        return flat_search(self.df, query, k, self.metric)


def kmeans(x: np.ndarray, k: int, rounds: int = 25, seed: int = 42) -> np.ndarray:
    """Lloyd's iterations from rows drawn at random; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        cell = _cells(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        n = np.bincount(cell, minlength=k)
        new = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], c)
        moved = np.abs(new - c).max()
        c = new
        if moved < 1e-6:
            break
    return c


def _cells(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


class InvertedFile:
    """Vectors in cells of their nearest centroid, with codes of the residual where n_sub is given; write it partitioned by cell, and a probe prunes partitions."""

    def __init__(self, metric: str = "cosine", n_clusters: int = 256, n_sub: int = 0, n_bits: int = 8):
        if metric not in METRICS:
            raise ValueError(metric)
        self.metric, self.n_clusters, self.n_sub, self.n_bits = metric, n_clusters, n_sub, n_bits
        self.centroids: np.ndarray | None = None
        self.books: list[np.ndarray] = []

    def _prepared(self, x: np.ndarray) -> np.ndarray:
        if self.metric != "cosine":
            return x
        n = np.linalg.norm(x, axis=-1, keepdims=True)
        return x / np.where(n == 0, 1, n)

    def train(self, df: DataFrame, id_col: str = "id", vector_col: str = "vec") -> InvertedFile:
        """On a sample of about TRAIN_MOST rows, drawn by a hash of the id and the vector; every row is indexed, whatever was drawn."""
        some = df.where(F.col(vector_col).isNotNull())
        rate = min(1.0, TRAIN_MOST / max(1, some.count()))
        drawn = some.where(F.pmod(F.xxhash64(id_col, vector_col), F.lit(1 << 30)) < int(rate * (1 << 30)))
        got = drawn.select(id_col, vector_col).toArrow().sort_by(id_col)
        x = self._prepared(np.stack(got.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
        self.centroids = kmeans(x, self.n_clusters)
        if self.n_sub:
            width = x.shape[1] // self.n_sub
            rest = x - self.centroids[_cells(x, self.centroids)]
            self.books = [kmeans(rest[:, i * width : (i + 1) * width], min(2**self.n_bits, len(x))) for i in range(self.n_sub)]
        return self

    def assign(self, df: DataFrame, id_col: str = "id", vector_col: str = "vec") -> DataFrame:
        """(id, vec, cell, codes)."""
        if self.centroids is None:
            raise RuntimeError("train first")
        sent = df.sparkSession.sparkContext.broadcast((self.centroids, self.books))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, books = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = self._prepared(np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
                cell = _cells(x, centroids)
                codes: list = [None] * len(x)
                if books:
                    w = x.shape[1] // len(books)
                    rest = x - centroids[cell]
                    codes = np.column_stack([_cells(rest[:, i * w : (i + 1) * w], b) for i, b in enumerate(books)]).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(codes, pa.list_(pa.int32()))], names=["id", "vec", "cell", "codes"])

        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vec")).mapInArrow(place, "id long, vec array<float>, cell int, codes array<int>")

    def add(self, assigned: DataFrame, df: DataFrame, id_col: str = "id", vector_col: str = "vec") -> DataFrame:
        """The assigned vectors and new ones; an id that is there already is there twice."""
        return assigned.unionByName(self.assign(df, id_col, vector_col))

    @staticmethod
    def remove(assigned: DataFrame, ids: Sequence[int]) -> DataFrame:
        return _without(assigned, ids)

    def batch_search(self, assigned: DataFrame, queries: DataFrame, k: int, nprobe: int | None = None, id_col: str = "id", vector_col: str = "vec") -> DataFrame:
        """(query_id, id, score) for many queries: each vector is held against the queries that probe its cell. Queries go in blocks."""
        blocks = max(1, -(-queries.count() // BLOCK))
        some = [queries.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b) for b in range(blocks)]
        return reduce(DataFrame.unionAll, [self._batch(assigned, x, k, nprobe, id_col, vector_col) for x in some])

    def _batch(self, assigned: DataFrame, queries: DataFrame, k: int, nprobe: int | None, id_col: str, vector_col: str) -> DataFrame:
        got = queries.select(F.col(id_col), F.col(vector_col)).toArrow()
        qid = got.column(0).to_numpy()
        q = self._prepared(np.stack(got.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)) if len(qid) else np.zeros((0, self.centroids.shape[1]))
        n = nprobe or max(1, int(np.sqrt(len(self.centroids))))
        near = ((self.centroids**2).sum(1)[None] - 2 * q @ self.centroids.T).argsort(axis=1, kind="stable")[:, :n]
        by_cell = {c: np.flatnonzero((near == c).any(1)) for c in np.unique(near).tolist()}
        sent = assigned.sparkSession.sparkContext.broadcast((qid, q, by_cell))
        metric, prepared = self.metric, self._prepared

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q, by_cell = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                x = prepared(np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
                for c in np.unique(cell).tolist():
                    own, who = np.flatnonzero(cell == c), by_cell.get(c, ())
                    for some, top, s in _nearest(q, who, x[own], k, metric, _SCORES):
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid[some], top.shape[1])), pa.array(ids[own][top].ravel()), pa.array(s.ravel())], names=["query_id", "id", "score"])

        return _best_of(assigned.select("id", "vec", "cell").mapInArrow(best, "query_id long, id long, score double"), k)

    def probes(self, query: Sequence[float], nprobe: int | None) -> list[int]:
        q = self._prepared(np.asarray(query, float))
        n = nprobe or max(1, int(np.sqrt(len(self.centroids))))
        return ((self.centroids - q) ** 2).sum(1).argsort(kind="stable")[:n].tolist()

    def search(self, assigned: DataFrame, query: Sequence[float], k: int, nprobe: int | None = None) -> DataFrame:
        """(id, score) from the nearest cells; with codes the score is the negative squared distance to the decoded vector."""
        cells = self.probes(query, nprobe)
        df = assigned.where(F.col("cell").isin(cells))
        if not self.books:
            return flat_search(df, query, k, self.metric)
        q = self._prepared(np.asarray(query, float))
        w = len(q) // self.n_sub
        rows = {c: [((b - (q - self.centroids[c])[i * w : (i + 1) * w]) ** 2).sum(1).tolist() for i, b in enumerate(self.books)] for c in cells}
        tables = df.sparkSession.createDataFrame([(c, t) for c, t in rows.items()], "cell int, lut array<array<double>>")
        distance = F.aggregate(F.zip_with("lut", "codes", lambda t, c: F.get(t, c)), F.lit(0.0), lambda s, x: s + x)
        return df.join(F.broadcast(tables), "cell").select("id", (-distance).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)
