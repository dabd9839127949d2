"""Shared helpers: table access, the shared folder for written tables, and argument checks."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession

from .textscan import mix, release


BATCH_BYTES = 8 << 20


def narrow_batches(spark: SparkSession) -> None:
    """Arrow batches of texts end at BATCH_BYTES, for as long as the session has Spark's own limit: a worker holds a few copies of a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).lower().rstrip("b") in ("64m", "67108864", "2147483647", "-1"):
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    narrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, which the session names in spark.checkpoint.dir.

    Only where that is unset (a local session, as in tests) is a temporary folder made and set."""
    narrow_batches(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='llm-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


_scratch: list[str] = []  # folders of the tables that are written just now, the innermost last


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{_scratch[-1] if _scratch else shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the table that written() made, once nothing needs it."""
    _remove(df.sparkSession, df._tessera_path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within go at its end: what is computed from them must be written by then, elsewhere."""
    _scratch.append(f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _remove(spark, _scratch.pop())


def kept(df: DataFrame) -> DataFrame:
    """written(), outside of any scratch folder."""
    held = _scratch[:]
    _scratch.clear()
    try:
        return written(df)
    finally:
        _scratch[:] = held


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length as bytes: their count, then one after the other."""
    return b"".join([len(columns[0]).to_bytes(8, "little"), *[np.ascontiguousarray(c).tobytes() for c in columns]])


def unpacked(blobs: Iterable[bytes], *tables: tuple[str, ...]) -> list[np.ndarray]:
    """The columns of packed blobs, joined; where a blob holds several tables, the columns of all of them."""
    parts: list[list[list[np.ndarray]]] = [[[np.zeros(0, k)] for k in kinds] for kinds in tables]
    for blob in blobs:
        at = 0
        for kinds, columns in zip(tables, parts, strict=True):
            n = int.from_bytes(blob[at : at + 8], "little")
            at += 8
            for out, k in zip(columns, kinds, strict=True):
                out.append(np.frombuffer(blob, k, n, at))
                at += n * np.dtype(k).itemsize
    return [np.concatenate(p) for columns in parts for p in columns]


def split(part: np.ndarray, parts: int, *columns: np.ndarray, detail: tuple[np.ndarray, ...] | None = None, more: tuple[np.ndarray, ...] | None = None, squeezed: bool = False) -> Iterator[pa.RecordBatch]:
    """The columns' rows as one row (part, blob) for each part that has any. detail, more: the part of each row of a second and third table, and its columns. squeezed: blobs are compressed by zlib, column after column, better than the shuffle does."""
    tables = [(part, columns)] + [(t[0], t[1:]) for t in (detail, more) if t]
    sorted_tables = []
    for of, cols in tables:
        order = np.argsort(of.astype(np.uint16) if parts <= 1 << 16 else of, kind="stable")
        sorted_tables.append((np.concatenate(([0], np.cumsum(np.bincount(of, minlength=parts)))), [c[order] for c in cols]))
    keys, blobs = [], []
    for k in np.flatnonzero(np.bincount(part, minlength=parts)).tolist():
        keys.append(k)
        blob = b"".join(packed(*[c[ends[k] : ends[k + 1]] for c in cols]) for ends, cols in sorted_tables)
        blobs.append(zlib.compress(blob, 1) if squeezed else blob)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


def exchange(df: DataFrame, mapper: Callable, reducer: Callable[[Iterator[bytes]], pa.Table], schema: str) -> DataFrame:
    """mapper turns Arrow batches of df into rows (part, blob), as from split(); reducer turns all blobs of one part into rows of `schema`.

    A blob holds some ten thousand records, so the shuffle moves few rows and no task works record by record."""

    def reduce(table: pa.Table) -> pa.Table:
        release()
        return reducer(x.as_py() for x in table.column("blob"))

    return df.mapInArrow(mapper, "part int, blob binary").groupBy("part").applyInArrow(reduce, schema)


FILTER_MOST = 27  # bits of a filter, as a power of two: 16 MB
_FILTER_PARTS = 5  # of its slices, as a power of two


class KeyFilter:
    """A Bloom filter of one hash, 16 bits for each key as far as FILTER_MOST goes. What isn't in it isn't among the keys;
    beyond that size it only lets more through, so what it lets through is joined with the keys themselves."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    @staticmethod
    def slots(columns: list[np.ndarray], bits: int) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = mix(h ^ c.astype(np.uint64))
        return (h >> np.uint64(64 - bits)).astype(np.int64)

    def holds(self, *columns: np.ndarray) -> np.ndarray:
        at = self.slots(list(columns), self.bits)
        return (self.table[at >> 3] >> (at & 7)) & 1 > 0

    @classmethod
    def of(cls, keys: DataFrame) -> KeyFilter:
        """Of all rows of `keys`, whose columns are long; built in slices by tasks."""
        bits = int(np.clip(np.ceil(np.log2(16 * max(1, keys.count()))), 12, FILTER_MOST))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    at = np.unique(cls.slots([c.to_numpy() for c in batch.columns], bits))
                    yield from split(at >> (bits - _FILTER_PARTS), 1 << _FILTER_PARTS, at.astype("u4"))

        return cls(bits, collected_bits(exchange(keys, place, lambda blobs: bit_slice(unpacked(blobs, ("u4",))[0], bits), "slice int, bits binary").collect(), bits))


def bit_slice(at: np.ndarray, bits: int, parts: int = _FILTER_PARTS) -> pa.Table:
    """The slice of a table of 2^bits bits in which the bits `at` are set; it has 2^parts slices."""
    width = 1 << (bits - parts)
    flags = np.zeros(width, bool)
    flags[at & (width - 1)] = True
    return pa.table({"slice": pa.array([int(at[0]) // width] if len(at) else [0], pa.int32()), "bits": [np.packbits(flags, bitorder="little").tobytes()]})


def collected_bits(slices: Iterable[Row], bits: int, parts: int = _FILTER_PARTS) -> np.ndarray:
    """The table of 2^bits bits; a slice without any may be missing, or have the number 0 and no bits."""
    out = np.zeros((1 << parts, 1 << (bits - parts - 3)), np.uint8)
    for r in slices:
        out[r["slice"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where df has such a column in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
