"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, order: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """df with `name`, the rows' numbers in order from `start` on. Rows are sorted in ranges, which a checkpoint holds fast, and
    a range's numbers begin after those of the ranges before: no task has all rows, and the driver gets a number for each range."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = F.monotonically_increasing_id()  # the partition, and the place in it in 33 bits
    part = F.shiftright(at, 33).cast("int")
    sizes = {r["p"]: r["n"] for r in rows.select(part.alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    before, total = [], start
    for p in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    return rows.withColumn(name, F.get(F.array(*[F.lit(b).cast("long") for b in before]), part) + at.bitwiseAND(F.lit((1 << 33) - 1)))


def last_of(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Of rows with equal keys the last by `order`, or else by their place in df; partial aggregates go through the shuffle."""
    placed = df if order else df.withColumn("__place", F.monotonically_increasing_id())
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(order or "__place"))
    return placed.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]).agg(best.alias("__r")).select("__r.*")
