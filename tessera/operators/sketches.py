"""Probabilistic membership as tables of bits and counters."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CounterOverflow

BITMAP = 1 << 18  # bits of a filter that is sent to all tasks, at most


@dataclass(frozen=True)
class Bloom:
    """Sizes for a number of items and a rate of false alarms; a bit is (h1 + i h2) mod m, of halves of an MD5."""

    expected: int = 10_000
    rate: float = 0.01

    @property
    def m(self) -> int:
        return max(1, math.ceil(-self.expected * math.log(self.rate) / math.log(2) ** 2))

    @property
    def k(self) -> int:
        return max(1, math.ceil(self.m / self.expected * math.log(2)))

    def bits_of(self, item: Column) -> Column:
        digest = F.md5(item.cast("string").cast("binary"))
        h1, h2 = (F.conv(F.substring(digest, p, 13), 16, 10).cast("long") for p in (1, 14))
        return F.transform(F.sequence(F.lit(0), F.lit(self.k - 1)), lambda i: (h1 + i * h2) % self.m)

    def build(self, items: DataFrame, column: str) -> DataFrame:
        """(bit) of all items."""
        return items.where(F.col(column).isNotNull()).select(F.explode(self.bits_of(F.col(column))).alias("bit")).distinct()

    def might_contain(self, bits: DataFrame, probes: DataFrame, column: str) -> DataFrame:
        """The probes with `maybe`: all bits of the probe are set. Up to BITMAP bits the filter is a bitmap in the scan of the probes; a larger one is joined, by its bits."""
        if self.m <= BITMAP:
            set_ = {r["w"]: r["b"] for r in bits.groupBy(F.floor(F.col("bit") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("b")).collect()}
            words = F.array(*[F.lit(set_.get(w, 0)).cast("long") for w in range(-(-self.m // 64))])
            test = F.forall(self.bits_of(F.col(column)), lambda i: F.call_function("shiftright", F.get(words, F.floor(i / 64).cast("int")), (i % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
            return probes.withColumn("maybe", F.coalesce(test, F.lit(False)))
        keyed = probes.select(F.col(column).alias("__p")).distinct().select("__p", F.explode(self.bits_of(F.col("__p"))).alias("bit"))
        hit = keyed.join(bits, "bit").groupBy("__p").agg((F.count_distinct("bit")).alias("n"))
        need = F.size(F.array_distinct(self.bits_of(F.col(column))))
        return probes.join(hit, probes[column] == hit["__p"], "left").withColumn("maybe", F.coalesce(F.col("n") == need, F.lit(False))).drop("__p", "n")

    def false_alarm_rate(self, n: int) -> float:
        return (1 - math.exp(-self.k * n / self.m)) ** self.k


@dataclass(frozen=True)
class CountingBloom(Bloom):
    max_count: int = 255

    def counters(self, changes: DataFrame, column: str, delta: str | None = None) -> DataFrame:
        """(bit, n) after additions and removals (delta is +1 or -1); counters never go below 0."""
        d = F.col(delta) if delta else F.lit(1)
        each = changes.where(F.col(column).isNotNull()).select(F.explode(F.array_distinct(self.bits_of(F.col(column)))).alias("bit"), d.cast("long").alias("d"))
        return each.groupBy("bit").agg(F.greatest(F.lit(0).cast("long"), F.sum("d")).alias("n")).where("n > 0")

    def checked(self, counters: DataFrame) -> DataFrame:
        if counters.where(F.col("n") > self.max_count).limit(1).count():
            raise CounterOverflow(f"beyond {self.max_count}")
        return counters
