"""Packing by power-of-two decomposition: no sequence crosses documents.

A document of n tokens is cut, from its start, into n // L pieces of the longest length L, then into
one piece for each set bit of the remainder, longest first. Equal lengths share a bucket, and every
piece has its place in its bucket, so that batches of equal-length sequences can be read straight off.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table, written

TOKEN = r"[^ \t\n\r\f]+[ \t\n\r\f]*|^[ \t\n\r\f]+"
MAX_LENGTH = 2048
BATCH_TOKENS = 65536
RUN = 4096  # rows that are ranked together, about
RUNS_MOST = 16384
LETTERS = 32
_DRAWN = 16
_NONE = -(1 << 63)  # stands for a null id where rows are put in runs: before all others


def tokens(text: Column) -> Column:
    """Words with the white space after them; white space at the start is a token. Joined, they give the text again."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _bounds(sizes: DataFrame, run: int) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """Where runs of about `run` rows end, by (doc_id, first letters), null first: of numbers drawn at random, which only moves the ends.

    There are RUNS_MOST of them at most, so runs are longer where there are very many rows."""
    total = sizes.count()
    runs = min(RUNS_MOST, -(-total // run))
    if runs < 2:
        return np.zeros(0, np.int64), []
    drawn = sizes if total <= _DRAWN * runs else sizes.where(F.rand(7) < _DRAWN * runs / total)
    rows = sorted((_NONE if r[0] is None else r[0], r[1]) for r in drawn.select("doc_id", "letters").collect())  # _DRAWN numbers a run
    ends = sorted({rows[k * len(rows) // runs] for k in range(1, runs)}) if rows else []
    return np.array([e[0] for e in ends], np.int64), ends


def _run_of(ids: np.ndarray, letters: pd.Series, numbers: np.ndarray, ends: list[tuple[int, str]]) -> np.ndarray:
    """How many ends are at (id, letters) or before it. Letters matter only where a run ends within one id."""
    out = np.searchsorted(numbers, ids, side="left")
    for i in np.intersect1d(ids, numbers).tolist():
        lo, hi = np.searchsorted(numbers, i, side="left"), np.searchsorted(numbers, i, side="right")
        at = np.flatnonzero(ids == i)
        out[at] = lo + np.searchsorted(np.array([e[1] for e in ends[lo:hi]], object), letters.to_numpy()[at].astype(object), side="right")
    return out.astype(np.int64)


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, batch_tokens: int = BATCH_TOKENS, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece (from 0 in the document), start, length, place (from 0 in the bucket), batch, text.

    `place` follows (doc_id with null first, text, start) among all pieces of one length; a batch holds
    batch_tokens // length places of one bucket. Neither is found by a global sort: documents are ranked
    inside runs of about `run` rows, whatever their ids are, and the runs' totals are summed over, so a bucket is
    never in one task. A run may end within the rows of one id (or of null), by the first LETTERS of the text.

    Null and empty texts have no pieces; a very long text has one piece of max_length after the other. A null doc_id
    is kept and sorts first. A repeated row is packed each time that it occurs, and rows that tie in id and text are
    packed one after the other, in either order. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    top = max_length.bit_length() - 1
    if 1 << top != max_length:
        raise ValueError("max_length must be a power of two")
    shared_dir(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("text <> ''")
    letters = F.substring("text", 1, LETTERS).alias("letters")
    small = written(base.select("doc_id", letters, F.size(tokens(F.col("text"))).alias("n")))
    numbers, ends = _bounds(small, run)
    sent = docs.sparkSession.sparkContext.broadcast((numbers, ends))  # RUNS_MOST at most

    @F.pandas_udf("long")
    def run_of(ids: pd.Series, letters: pd.Series) -> pd.Series:
        numbers, ends = sent.value
        return pd.Series(_run_of(ids.to_numpy(), letters, numbers, ends))

    run_id = run_of(F.coalesce("doc_id", F.lit(_NONE)), F.col("letters")) if ends else F.lit(0).cast("long")

    def count(k: int) -> Column:
        bits = F.shiftright("n", k)
        return (bits if k == top else bits.bitwiseAND(F.lit(1))).cast("long")

    sizes = range(top + 1)
    totals = small.withColumn("run", run_id).groupBy("run").agg(*[F.sum(count(k)).alias(f"c{k}") for k in sizes])
    before: dict[int, list[int]] = {}
    at = [0] * (top + 1)
    for r in sorted(totals.collect(), key=lambda r: r["run"]):  # a row for each run
        before[r["run"]] = list(at)
        at = [x + r[f"c{k}"] for k, x in enumerate(at)]
    offsets = docs.sparkSession.createDataFrame([(k, v) for k, v in before.items()], "run long, offset array<long>")
    order = Window.partitionBy("run").orderBy(F.asc_nulls_first("doc_id"), "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = base.select("doc_id", "text", letters).withColumn("run", run_id).drop("letters").repartition("run").withColumn("n", F.size(tokens(F.col("text"))))
    ranked = counted.withColumn("within", F.array(*[F.sum(count(k)).over(order) - count(k) for k in sizes])).join(F.broadcast(offsets), "run")
    full = F.shiftright("n", top)
    # (k, start, index among the document's pieces of that length)
    bits = F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), F.shiftleft(F.shiftright("n", k + 1), k + 1).alias("start"), F.when(count(k) == 1, 0).alias("i")) for k in reversed(range(top))]),
        lambda x: x["i"].isNotNull(),
    )
    longest = F.transform(F.sequence(F.lit(0), full - 1), lambda i: F.struct(F.lit(top).alias("k"), (i * max_length).alias("start"), i.alias("i")))
    pieces = F.when(full > 0, F.concat(longest, bits)).otherwise(bits) if top else longest
    cut = ranked.select("doc_id", tokens(F.col("text")).alias("tokens"), "within", "offset", F.posexplode(pieces).alias("piece", "p"))
    length = F.call_function("shiftleft", F.lit(1), F.col("p.k"))
    place = F.element_at("offset", F.col("p.k") + 1) + F.element_at("within", F.col("p.k") + 1) + F.col("p.i")
    return cut.select(
        "doc_id",
        F.col("piece").cast("long").alias("piece"),
        F.col("p.start").cast("long").alias("start"),
        length.cast("long").alias("length"),
        place.alias("place"),
        F.floor(place / F.floor(F.greatest(F.lit(batch_tokens), length) / length)).alias("batch"),
        F.array_join(F.slice("tokens", F.col("p.start") + 1, length), "").alias("text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


SQL = rf"""
with counted as (
  select doc_id, text, regexp_extract_all(text, '{TOKEN}') as tokens from documents where text <> ''
), sized as (select *, len(tokens) as n from counted
), cut as (
  select doc_id, tokens, i * {MAX_LENGTH} as start, {MAX_LENGTH} as length, text from sized, unnest(range(n // {MAX_LENGTH})) as u(i)
  union all
  select doc_id, tokens, (n >> (k + 1)) << (k + 1), 1 << k, text from sized, unnest(range({MAX_LENGTH.bit_length() - 1})) as u(k) where (n >> k) & 1 = 1
), placed as (
  select *, row_number() over (partition by length order by doc_id nulls first, text, start) - 1 as place,
    row_number() over (partition by doc_id, text order by start) - 1 as piece from cut
)
select doc_id, cast(piece as bigint) as piece, cast(start as bigint) as start, cast(length as bigint) as length, cast(place as bigint) as place,
  cast(place // greatest({BATCH_TOKENS} // length, 1) as bigint) as batch,
  array_to_string(list_slice(tokens, start + 1, start + length), '') as text
from placed
"""
