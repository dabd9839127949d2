"""A corpus pipeline: each stage works on all that the stage before it kept.

The stages: documents that the quality model rejects go; of each group of near duplicates one document
stays; passages that came before are cut; documents that hold benchmark items go; the rest is packed.

For every stage but the last: columns stay as they are, whatever their names and however many there are; an empty
table gives an empty one; very long texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard, packing, quality, repeats
from tessera.llm.common import discard, kept, scratch, shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the documents that the weak-label model rates good. Null and empty texts are rated like others (as texts
    without words), whatever their doc_id; repeated rows are rated alike; a score that ties with the threshold stays."""
    shared_dir(spark)
    return quality.keep_good(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each connected group of near duplicates, the document of least doc_id. Rows without doc_id stay, and
    those whose text is null, empty or without words; repeated rows of one doc_id all stay or all go."""
    shared_dir(spark)
    return jaccard.one_of_each(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: texts without passages that an earlier document, or the same one further up, holds. Earlier is by doc_id,
    then by the text's hash. Rows without doc_id, null and empty texts stay as they are; repeated rows are one document
    and are cut alike; a text that loses all its words goes."""
    shared_dir(spark)
    return repeats.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the documents that hold no benchmark item. Null and empty texts hold none; a null doc_id is one like any
    other; repeated rows all stay or all go; null items hold nothing."""
    shared_dir(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the documents' pieces of power-of-two lengths, with their places in the buckets. Null and empty texts have no
    pieces; a null doc_id sorts first; repeated rows are packed each time; further columns aren't returned."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("repeats", repeats_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# SQL can't express the trained and approximate stages: tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written in the shared folder and read again. What a stage wrote for itself goes
    when its result is written, and a result goes when the next one is; the last stage's input stays, as its rows come from there."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = kept(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
