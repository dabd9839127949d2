"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, images, jaccard, langid, packing, quality, repeats, suffixes, toxicity, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_image_copies": images.query,
    "op2_urlfilter": urlfilter.query,
    "op3_packing": packing.query,
    "op4_jaccard_join": jaccard.query,
    "op5_toxicity": toxicity.query,
    "op6_decontaminate": decontaminate.query,
    "op7_quality": quality.query,
    "op8_suffix_dedup": suffixes.query,
    "op9_langid": langid.query,
    "op10_repeats": repeats.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_packing": packing.SQL,
}
