"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is the elementwise product (binding) of
its letters' vectors, each rotated (permuted) by its place; a document is the sum (bundle) of its
trigrams' vectors; a language's prototype is the bundle of unit document vectors of that language.
Documents get the language of the prototype with the highest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .textscan import chunks, mix

DIMENSIONS = 512
PER_LANGUAGE = 500  # labelled documents that a prototype is made from, at most
_CELLS = 1 << 22


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of +1 and -1 for each code point, the same in every process; code point 0 stands for what is between words."""
    seeds = mix(points.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    words = mix(seeds[:, None] + np.arange(-(-dimensions // 64), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(points), -1), axis=1)[:, :dimensions]
    return (bits.astype(np.int8) * 2 - 1).astype(np.int8)


def _letter_points(points: np.ndarray) -> np.ndarray:
    """Code points with 0 for what isn't a letter."""
    ascii_letter = (points >= 97) & (points <= 122)
    other = (points >= 0xC0) & (points != 0xD7) & (points != 0xF7) & ~((points >= 0x2000) & (points < 0x2070)) & ~((points >= 0x3000) & (points < 0x3005))
    return np.where(ascii_letter | other | (points == 0xAA) | (points == 0xBA), points, 0)


def vectors(texts: pa.Array, dimensions: int = DIMENSIONS) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, bundle of each text) of runs of texts; a text without letters has zeros."""
    for i, j, offs, data in chunks(pc.utf8_lower(texts)):
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        doc = np.repeat(np.arange(j - i), np.diff(lead[offs]))
        points = _letter_points(points)
        # one 0 before each text and after it; runs of 0 are one
        at = np.column_stack((lead[offs[:-1]], lead[offs[1:]])).ravel()
        points, doc = np.insert(points, at, 0), np.insert(doc, at, np.repeat(np.arange(j - i), 2))
        keep = np.ones(len(points), dtype=bool)
        keep[1:] = (points[1:] != 0) | (points[:-1] != 0) | (doc[1:] != doc[:-1])
        points, doc = points[keep], doc[keep]
        alphabet, index = np.unique(points, return_inverse=True)
        k = len(alphabet)
        same = doc[2:] == doc[:-2]
        code = (index[:-2].astype(np.int64) * k + index[1:-1]) * k + index[2:]
        code, doc = code[same], doc[2:][same]
        if k**3 <= _CELLS:
            seen = np.flatnonzero(np.bincount(code, minlength=k**3))
            back = np.zeros(k**3, dtype=np.int64)
            back[seen] = np.arange(len(seen))
            column = back[code]
        else:
            seen, column = np.unique(code, return_inverse=True)
        letter = letter_vectors(alphabet, dimensions)
        twice, once = np.roll(letter, 2, axis=1), np.roll(letter, 1, axis=1)
        out = np.zeros((j - i, dimensions), dtype=np.float32)
        width = min(max(1, len(seen)), 1 << 14)
        height = max(1, _CELLS // width)
        for c in range(0, len(seen), width):
            s = seen[c : c + width]
            bound = (twice[s // (k * k)] * once[s // k % k] * letter[s % k]).astype(np.float32)
            inside = (column >= c) & (column < c + width) if len(seen) > width else slice(None)
            col, row = column[inside] - c, doc[inside]
            first = np.searchsorted(row, np.arange(0, j - i + height, height))
            for b in range(len(first) - 1):
                lo, n = b * height, min(height, j - i - b * height)
                here = slice(first[b], first[b + 1])
                counts = np.bincount((row[here] - lo) * len(s) + col[here], minlength=n * len(s)).reshape(n, len(s)).astype(np.float32)
                out[lo : lo + n] += counts @ bound
        yield i, j, out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-9, np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True)))


def prototypes(docs: DataFrame, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototype of each language, from at most `per_language` labelled documents of each, drawn by a hash of id and text. Repeated rows are drawn together or not at all, and count once."""
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)).alias("u")).where("lang is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return {}
    # a draw with some to spare, then exactly per_language of them
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 1.5 * per_language / n + 20 / n) * (1 << 30)))])
    drawn = known.where("text is not null").where(F.col("u") < F.element_at(limit, F.col("lang"))).distinct()
    first = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("u", F.xxhash64("text")))).where(F.col("k") <= per_language)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, v in vectors(batch.column(1), dimensions):
                unit = np.rint(_unit(v) * (1 << 20)).astype(np.int64)  # whole numbers: sums don't depend on their order
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(list(unit), pa.list_(pa.int64()))], names=["lang", "v"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "v": [np.sum(np.stack(group["v"].to_list()), axis=0)]})

    sums = first.select("lang", "text").mapInArrow(bundle, "lang string, v array<long>").groupBy("lang").applyInPandas(add, "lang string, v array<long>").collect()
    return {r["lang"]: _unit(np.array([r["v"]], dtype=np.float64))[0] for r in sorted(sums, key=lambda r: r["lang"]) if any(r["v"])}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray] | None = None, dimensions: int = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: doc_id, language, cosine, margin (to the second language; null where there is one).

    A text that is null, empty or without letters, and every text where no document is labelled, has null
    in all three. Very long texts are bundled whole. Ties go to the first language by name. A null doc_id stays null.
    Repeated rows are rated each time. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    profiles = profiles if profiles is not None else prototypes(docs, dimensions=dimensions, id_col=id_col, text_col=text_col, lang_col=lang_col)
    names = sorted(profiles)
    of = np.stack([profiles[x] for x in names]).astype(np.float32) if names else np.zeros((0, dimensions), np.float32)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, v in vectors(batch.column(1), dimensions):
                n = j - i
                some = v.any(axis=1) & bool(names)
                cosine = _unit(v) @ of.T if names else np.zeros((n, 1))
                best = cosine.argmax(axis=1)
                top = cosine[np.arange(n), best]
                second = np.partition(cosine, -2, axis=1)[:, -2] if cosine.shape[1] > 1 else top
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n),
                        pa.array([names[b] if s else None for b, s in zip(best.tolist(), some.tolist(), strict=True)], pa.string()),
                        pa.array(top.astype(float), mask=~some),
                        pa.array((top - second).astype(float), mask=~(some & (cosine.shape[1] > 1))),
                    ],
                    names=["doc_id", "language", "cosine", "margin"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(rate, "doc_id long, language string, cosine double, margin double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
