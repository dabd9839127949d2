"""Extensions on streams: counters by window, and queues and caches as keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, ts: str, group: str, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, group, n, total): tumbling or sliding counts; on a stream, events later than `late` are dropped."""
    base = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    base = base.withWatermark("__ts", late) if events.isStreaming else base
    w = F.window("__ts", width, slide) if slide else F.window("__ts", width)
    return base.groupBy(w.alias("w"), group).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), group, "n", "total")


def lru_stream(log: DataFrame, cache: str, key: str, seq: str, op: str, capacity: int) -> DataFrame:
    """(cache, keys): contents of each cache after every batch, most recent first. State is `capacity` keys a cache."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[Any] = list(state.get[0]) if state.exists else []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            if row.op == "delete" or row.key in held:
                present = row.key in held
                held = [k for k in held if k != row.key]
                if row.op != "delete" and present:
                    held.append(row.key)
            elif row.op == "set":
                held = [*held, row.key][-capacity:]
        state.update((held,))
        yield pd.DataFrame({"cache": [group[0]], "keys": [list(reversed(held))]})

    df = log.select(F.col(cache).cast("string").alias("cache"), F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(op).alias("op"))
    return df.groupBy("cache").applyInPandasWithState(step, "cache string, keys array<string>", "keys array<string>", "update", GroupStateTimeout.NoTimeout)


def queue_stream(events: DataFrame, queue: str, seq: str, body: str) -> DataFrame:
    """(queue, seq, body): pushes are passed on in order, each once; state is the last sequence number passed on."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -(1 << 62)
        rows = pd.concat(list(batches)).drop_duplicates("seq").sort_values("seq")
        rows = rows[rows["seq"] > last]
        if len(rows):
            state.update((int(rows["seq"].iloc[-1]),))
        yield rows.assign(queue=group[0])[["queue", "seq", "body"]]

    df = events.select(F.col(queue).cast("string").alias("queue"), F.col(seq).cast("long").alias("seq"), F.col(body).cast("string").alias("body"))
    return df.groupBy("queue").applyInPandasWithState(step, "queue string, seq long, body string", "last long", "append", GroupStateTimeout.NoTimeout)
