"""Maps, ordered maps, sequences, sets, queues and caches, as tables and functions of tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Empty, HasHoles, NestingNotSupported, NotFound, SchemaError
from ..functions.types import dt_key
from ..session import last_of, numbered
from .dataset import Ref


def _row(like: DataFrame, fields: dict[str, Any]) -> DataFrame:
    """One row with the columns of `like`; those that aren't given are null."""
    if unknown := set(fields) - set(like.columns):
        raise SchemaError(f"unknown fields {sorted(unknown)}")
    return like.sparkSession.range(1).select(*[F.lit(fields.get(f.name)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def _column(like: DataFrame, name: str, values: DataFrame | list[Any]) -> DataFrame:
    """Distinct values as one column of the kind that `like` has: of a list, or of a DataFrame's first column."""
    kind = like.schema[name].dataType
    if isinstance(values, DataFrame):
        return values.select(F.col(values.columns[0]).cast(kind).alias(name)).distinct()
    return like.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField(name, kind)])).distinct()


@dataclass(frozen=True)
class KeyedMap:
    """key -> record; ordered access by the key where asked."""

    df: DataFrame
    key: str = "_key"

    def get(self, key: Any) -> DataFrame:
        return self.df.where(F.col(self.key) == F.lit(key))

    def get_fields(self, key: Any, fields: list[str]) -> DataFrame:
        return self.get(key).select(*fields)

    def get_many(self, keys: DataFrame) -> DataFrame:
        """Records of the keys that exist; Spark picks the join by the sizes."""
        return self.df.join(keys.select(F.col(keys.columns[0]).alias(self.key)).distinct(), self.key)

    def get_ref(self, key: Any) -> Ref:
        return Ref(self, key)

    def contains(self, key: Any) -> bool:
        return not self.get(key).isEmpty()

    __contains__ = contains

    def __len__(self) -> int:
        return self.df.count()

    def put(self, records: DataFrame, order: str | None = None) -> KeyedMap:
        """Records over those of the same key; of records with one key the last by `order`, or by place, wins."""
        new = last_of(records, [self.key], order).select(*self.df.columns)
        return replace(self, df=self.df.join(new.select(self.key), self.key, "left_anti").unionByName(new))

    def put_one(self, key: Any, **fields: Any) -> KeyedMap:
        return self.put(_row(self.df, {self.key: key, **fields}))

    def remove(self, keys: DataFrame | list[Any], missing: str = "raise") -> KeyedMap:
        """Without the keys: a list, or a DataFrame's first column. A key that isn't there is an error unless missing is 'ignore'."""
        keys = _column(self.df, self.key, keys)
        if missing == "raise" and (bad := keys.join(self.df, self.key, "left_anti").limit(1).collect()):
            raise NotFound(bad[0][0])
        return replace(self, df=self.df.join(keys, self.key, "left_anti").select(*self.df.columns))

    def set_fields(self, key: Any, **changes: Any) -> KeyedMap:
        if unknown := set(changes) - set(self.df.columns) or ({self.key} & set(changes)):
            raise SchemaError(f"can't set {sorted(unknown)}")
        if not self.contains(key):
            raise NotFound(key)
        hit = F.col(self.key) == F.lit(key)
        return replace(self, df=self.df.withColumns({f: F.when(hit, F.lit(v).cast(self.df.schema[f].dataType)).otherwise(F.col(f)) for f, v in changes.items()}))

    def record(self, key: Any) -> dict[str, Any]:
        got = self.get(key).limit(1).collect()
        if not got:
            raise NotFound(key)
        return {k: v for k, v in got[0].asDict(True).items() if k != self.key}

    def keys(self) -> DataFrame:
        return self.df.select(self.key)

    def values(self) -> DataFrame:
        return self.df.drop(self.key)

    def items(self) -> DataFrame:
        return self.df

    def to_dict(self) -> dict[Any, dict]:
        """All of it, on the driver."""
        return {r[self.key]: {k: v for k, v in r.asDict(True).items() if k != self.key} for r in self.df.toLocalIterator()}


@dataclass(frozen=True)
class OrderedMap(KeyedMap):
    def items(self, reverse: bool = False) -> DataFrame:
        return self.df.orderBy(F.col(self.key).desc() if reverse else F.col(self.key).asc())

    def range(self, start: Any = None, end: Any = None, inclusive: tuple[bool, bool] = (True, True), reverse: bool = False) -> DataFrame:
        k, df = F.col(self.key), self.df
        if start is not None:
            df = df.where(k >= F.lit(start) if inclusive[0] else k > F.lit(start))
        if end is not None:
            df = df.where(k <= F.lit(end) if inclusive[1] else k < F.lit(end))
        return df.orderBy(k.desc() if reverse else k.asc())

    def range_keys(self, *args: Any, **kw: Any) -> DataFrame:
        return self.range(*args, **kw).select(self.key)

    def prefix(self, text: str) -> DataFrame:
        if not isinstance(self.df.schema[self.key].dataType, T.StringType):
            raise SchemaError("prefixes are of string keys")
        return self.df.where(F.col(self.key).startswith(text)).orderBy(self.key)

    def range_dt(self, start: Any, end: Any, precision: str = "second") -> DataFrame:
        lo, hi = (dt_key(F.lit(x).cast("timestamp_ntz"), precision) for x in (start, end))
        return self.df.where(F.col(self.key).between(lo, hi)).orderBy(self.key)

    def _dt(self, at: Any, precision: str) -> Any:
        return self.df.sparkSession.range(1).select(dt_key(F.lit(at).cast("timestamp_ntz"), precision)).first()[0]

    def get_dt(self, at: Any, precision: str = "second") -> DataFrame:
        return self.df.where(F.col(self.key) == dt_key(F.lit(at).cast("timestamp_ntz"), precision))

    def set_dt(self, at: Any, precision: str = "second", **fields: Any) -> OrderedMap:
        return self.put_one(self._dt(at, precision), **fields)

    def extremes(self) -> DataFrame:
        return self.df.agg(F.min(self.key).alias("min"), F.max(self.key).alias("max"))

    def laid_out(self) -> DataFrame:
        """In ranges of the key, each sorted: write this, and ranges read few files."""
        return self.df.repartitionByRange(self.key).sortWithinPartitions(self.key)


@dataclass(frozen=True)
class Sequence:
    """Rows in order of `pos`; deleted ones keep their place in `valid`. Indexes count live rows from 0."""

    df: DataFrame
    pos: str = "_pos"
    valid: str = "_valid"

    def live(self) -> DataFrame:
        """With `_index`."""
        return numbered(self.df.where(F.col(self.valid)), [self.pos], "_index")

    def __len__(self) -> int:
        return self.df.where(F.col(self.valid)).count()

    def append(self, records: DataFrame, order: str) -> Sequence:
        """Records at the end, in order of a column of theirs, which isn't kept unless it is a field."""
        last = self.df.agg(F.max(self.pos)).first()[0]
        new = numbered(records.withColumn("__order", F.col(order)), ["__order"], self.pos, 0 if last is None else last + 1).withColumn(self.valid, F.lit(True))
        return replace(self, df=self.df.unionByName(new.select(*self.df.columns)))

    def _pos_of(self, i: int) -> Any:
        got = self.at(i).limit(1).collect()
        if not got:
            raise IndexError(i)
        return got[0][self.pos]

    def set(self, i: int, **changes: Any) -> Sequence:
        if unknown := set(changes) - set(self.df.columns):
            raise SchemaError(f"unknown fields {sorted(unknown)}")
        hit = F.col(self.pos) == self._pos_of(i)
        return replace(self, df=self.df.withColumns({f: F.when(hit, F.lit(v).cast(self.df.schema[f].dataType)).otherwise(F.col(f)) for f, v in changes.items()}))

    def delete_at(self, i: int) -> Sequence:
        gone = self._pos_of(i)
        return replace(self, df=self.df.withColumn(self.valid, F.col(self.valid) & (F.col(self.pos) != gone)))

    def sparse(self, most: float = 0.3) -> bool:
        """Whether more than this share of the rows is deleted, so that compact() is due."""
        n, live = self.df.agg(F.count("*"), F.count_if(self.valid)).first()
        return n > 0 and (n - live) / n > most

    def slice_array(self, start: int = 0, stop: int | None = None) -> pa.Table:
        """Rows by position, in columns on the driver; a deleted row between is an error, as positions would shift."""
        if not self.df.where(~F.col(self.valid)).isEmpty():
            raise HasHoles("compact the sequence first")
        return self.slice(start, stop).drop("_index", self.valid).toArrow()

    def at(self, i: int) -> DataFrame:
        return self.live().where(F.col("_index") == (i + len(self) if i < 0 else i))

    def slice(self, start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
        lo, hi, by = slice(start, stop, step).indices(len(self))
        i = F.col("_index")
        if by > 0:
            return self.live().where((i >= lo) & (i < hi) & ((i - lo) % by == 0)).orderBy("_index")
        return self.live().where((i <= lo) & (i > hi) & ((F.lit(lo) - i) % -by == 0)).orderBy(i.desc())

    def delete(self, positions: DataFrame) -> Sequence:
        gone = positions.select(F.col(positions.columns[0]).alias(self.pos), F.lit(True).alias("__gone"))
        return replace(self, df=self.df.join(gone, self.pos, "left").withColumn(self.valid, F.col(self.valid) & F.col("__gone").isNull()).select(*self.df.columns))

    def compact(self) -> Sequence:
        return replace(self, df=self.df.where(F.col(self.valid)))


@dataclass(frozen=True)
class StringSet:
    df: DataFrame
    column: str = "member"

    def union(self, other: StringSet) -> StringSet:
        return replace(self, df=self.df.union(other.df.select(self.column)).distinct())

    def intersection(self, other: StringSet) -> StringSet:
        return replace(self, df=self.df.join(other.df, self.column, "left_semi"))

    def difference(self, other: StringSet) -> StringSet:
        return replace(self, df=self.df.join(other.df, self.column, "left_anti"))

    def issubset(self, other: StringSet) -> bool:
        return self.difference(other).df.isEmpty()

    def issuperset(self, other: StringSet) -> bool:
        return other.issubset(self)

    def isdisjoint(self, other: StringSet) -> bool:
        return self.intersection(other).df.isEmpty()

    def __contains__(self, member: str) -> bool:
        return not self.df.where(F.col(self.column) == member).isEmpty()

    def __len__(self) -> int:
        return self.df.count()

    def contains(self, members: DataFrame) -> DataFrame:
        """The first column's values with `found`."""
        asked = members.select(F.col(members.columns[0]).alias(self.column)).distinct()
        return asked.join(self.df.withColumn("found", F.lit(True)), self.column, "left").select(self.column, F.coalesce("found", F.lit(False)).alias("found"))

    def add(self, member: str) -> StringSet:
        return self.update([member])

    def update(self, members: DataFrame | list[str]) -> StringSet:
        return replace(self, df=self.df.union(_column(self.df, self.column, members)).distinct())

    def pop(self) -> tuple[str, StringSet]:
        """The least member, and the others."""
        least = self.df.agg(F.min(self.column)).first()[0]
        if least is None:
            raise Empty("the set is empty")
        return least, self.discard(least)

    def clear(self) -> StringSet:
        return replace(self, df=self.df.limit(0))

    def remove(self, member: str) -> StringSet:
        if member not in self:
            raise NotFound(member)
        return self.discard(member)

    def discard(self, member: str) -> StringSet:
        return replace(self, df=self.df.where(F.col(self.column) != member))


@dataclass(frozen=True)
class Fifo:
    """Rows in order of `seq`; those before `head` are taken."""

    df: DataFrame
    seq: str = "_seq"
    head: Any = None

    def waiting(self) -> DataFrame:
        return self.df if self.head is None else self.df.where(F.col(self.seq) >= F.lit(self.head))

    def drain(self) -> DataFrame:
        return self.waiting().orderBy(self.seq)

    def __len__(self) -> int:
        return self.waiting().count()

    def push(self, records: DataFrame, order: str) -> Fifo:
        """Records at the tail, in order of a column of theirs, which isn't kept unless it is a field."""
        last = self.df.agg(F.max(self.seq)).first()[0]
        new = numbered(records.withColumn("__order", F.col(order)), ["__order"], self.seq, 0 if last is None else last + 1)
        return replace(self, df=self.df.unionByName(new.select(*self.df.columns)))

    def push_one(self, **fields: Any) -> Fifo:
        last = self.df.agg(F.max(self.seq)).first()[0]
        return replace(self, df=self.df.unionByName(_row(self.df, {**fields, self.seq: 0 if last is None else last + 1})))

    def places(self) -> DataFrame:
        """What waits, with `place` from 1 on."""
        return numbered(self.waiting(), [self.seq], "place", 1)

    def peek(self) -> DataFrame:
        return self.drain().limit(1)

    def pop(self) -> tuple[dict, Fifo]:
        two = self.drain().limit(2).collect()
        if not two:
            raise Empty("the queue is empty")
        rest = two[1][self.seq] if len(two) > 1 else None
        return two[0].asDict(True), replace(self, head=rest) if len(two) > 1 else replace(self, df=self.df.limit(0))


def priority_order(df: DataFrame, priority: str, seq: str, max_first: bool = True) -> list[Column]:
    return [F.col(priority).desc() if max_first else F.col(priority).asc(), F.col(seq).asc()]


def drain_priority(df: DataFrame, priority: str, seq: str, max_first: bool = True, limit: int | None = None) -> DataFrame:
    """In order of priority, first come first served among equals."""
    out = df.orderBy(*priority_order(df, priority, seq, max_first))
    return out if limit is None else out.limit(limit)


def pop_priority(df: DataFrame, priority: str, seq: str, n: int = 1, max_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """(the first n, the others)."""
    head = drain_priority(df, priority, seq, max_first, n)
    return head, df.join(head.select(seq), seq, "left_anti")


@dataclass(frozen=True)
class PriorityQueue:
    """Rows with a priority and a number of arrival; the first of equals is taken first."""

    df: DataFrame
    priority: str = "priority"
    seq: str = "_seq"
    max_first: bool = True

    def __len__(self) -> int:
        return self.df.count()

    def push(self, records: DataFrame, order: str) -> PriorityQueue:
        return replace(self, df=Fifo(self.df, self.seq).push(records, order).df)

    def push_one(self, **fields: Any) -> PriorityQueue:
        return replace(self, df=Fifo(self.df, self.seq).push_one(**fields).df)

    def drain(self, limit: int | None = None) -> DataFrame:
        return drain_priority(self.df, self.priority, self.seq, self.max_first, limit)

    def peek(self) -> DataFrame:
        return self.drain(1)

    def pop(self, n: int = 1) -> tuple[list[dict], PriorityQueue]:
        head = [r.asDict(True) for r in self.drain(n).collect()]
        if not head:
            raise Empty("the queue is empty")
        return head, replace(self, df=self.df.where(~F.col(self.seq).isin([r[self.seq] for r in head])))


@dataclass(frozen=True)
class LruMap:
    """At most `capacity` records; `used` grows with each access. Reading promotes, asking whether a key is there doesn't."""

    df: DataFrame
    capacity: int
    key: str = "_key"
    used: str = "_used"

    def _now(self) -> int:
        return (self.df.agg(F.max(self.used)).first()[0] or 0) + 1

    def __len__(self) -> int:
        return self.df.count()

    def __contains__(self, key: Any) -> bool:
        return not self.df.where(F.col(self.key) == F.lit(key)).isEmpty()

    def is_full(self) -> bool:
        return len(self) >= self.capacity

    def keys(self) -> DataFrame:
        """Most recent first."""
        return self.df.orderBy(F.col(self.used).desc()).select(self.key)

    def _touched(self, key: Any, changes: dict[str, Any]) -> LruMap:
        hit = F.col(self.key) == F.lit(key)
        return replace(self, df=self.df.withColumns({f: F.when(hit, F.lit(v).cast(self.df.schema[f].dataType)).otherwise(F.col(f)) for f, v in {**changes, self.used: self._now()}.items()}))

    def set(self, key: Any, **fields: Any) -> LruMap:
        """A key that is there has the given fields changed; unknown fields are passed over. A new one puts out the least recent when the map is full."""
        known = {k: v for k, v in fields.items() if k in self.df.columns and k not in (self.key, self.used)}
        if key in self:
            return self._touched(key, known)
        rows = self.df.unionByName(_row(self.df, {**known, self.key: key, self.used: self._now()}))
        return replace(self, df=rows.orderBy(F.col(self.used).desc()).limit(self.capacity))

    def get(self, key: Any) -> tuple[dict[str, Any] | None, LruMap]:
        got = self.df.where(F.col(self.key) == F.lit(key)).limit(1).collect()
        if not got:
            return None, self
        return {k: v for k, v in got[0].asDict(True).items() if k not in (self.key, self.used)}, self._touched(key, {})

    def delete(self, key: Any) -> LruMap:
        if key not in self:
            raise NotFound(key)
        return replace(self, df=self.df.where(F.col(self.key) != F.lit(key)))


def lru_of_puts(log: DataFrame, cache: str, key: str, seq: str, capacity: int) -> DataFrame:
    """(cache, key, seq): contents after a log of puts alone: the `capacity` keys put last. No sequential state."""
    last = log.groupBy(cache, key).agg(F.max(seq).alias(seq))
    return last.withColumn("__r", F.row_number().over(Window.partitionBy(cache).orderBy(F.col(seq).desc()))).where(F.col("__r") <= capacity).drop("__r")


def lru_replay(log: DataFrame, cache: str, key: str, seq: str, op: str, capacity: int, value: str | None = None) -> DataFrame:
    """(cache, key, value, rank): contents after a log of set, get and delete, most recent first. A get of a key that is gone changes nothing.
    Caches are replayed side by side, each in one pass over its sorted rows, and a task holds one cache's contents and an Arrow batch; one cache is sequential."""
    from collections import OrderedDict

    kinds = {f.name: f.dataType.simpleString() for f in log.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict = OrderedDict()
        of, types, done = None, None, ([], [], [], [])

        def close() -> None:
            done[0].extend([of] * len(held))
            done[1].extend(reversed(held))
            done[2].extend(reversed(held.values()))
            done[3].extend(range(len(held)))
            held.clear()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(done, types, strict=True)], names=["cache", "key", "value", "rank"])
            for x in done:
                x.clear()
            return out

        for batch in batches:
            types = [batch.schema.field(c).type for c in ("cache", "k", "v")] + [pa.int64()]
            for c, k, what, v in zip(*(batch.column(x).to_pylist() for x in ("cache", "k", "op", "v")), strict=True):
                if c != of and not (c != c and of != of):  # NaN is one cache
                    close()
                    of = c
                if what == "set":
                    held[k] = v
                    held.move_to_end(k)
                    if len(held) > capacity:
                        held.popitem(last=False)
                elif what == "get":
                    if k in held:
                        held.move_to_end(k)
                elif what == "delete":
                    held.pop(k, None)
            yield rows()
        close()
        if types:
            yield rows()

    df = log.select(F.col(cache).alias("cache"), F.col(key).alias("k"), F.col(op).alias("op"), F.col(seq).alias("seq"), (F.col(value) if value else F.lit(None).cast("string")).alias("v"))
    df = df.repartition("cache").sortWithinPartitions("cache", F.col("seq").asc_nulls_last())
    return df.select("cache", "k", "op", "v").mapInArrow(run, f"cache {kinds[cache]}, key {kinds[key]}, value {kinds[value] if value else 'string'}, rank long")


_INNER = {"map": {"map", "sequence", "set", "ordered", "queue"}, "sequence": {"map", "sequence", "set", "ordered", "queue"}, "ordered": {"map", "sequence", "set", "queue"}, "queue": {"map", "sequence", "set", "queue"}, "set": set(), "lru": {"map", "sequence"}, "bloom": set(), "vector": set()}


def nested(outer: str, inner: str, df: DataFrame, outer_key: str, key: Any = None) -> DataFrame:
    """The inner structure's table for one key of the outer one: nesting is a column. Reading makes nothing."""
    if inner not in _INNER.get(outer, set()):
        raise NestingNotSupported(f"{inner} in {outer}")
    return df if key is None else df.where(F.col(outer_key) == F.lit(key)).drop(outer_key)


@dataclass(frozen=True)
class Nested:
    """A map whose values are tables: one column is the outer key. `inner` names the structure of each value."""

    df: DataFrame
    outer_key: str
    inner: type = KeyedMap
    options: tuple = ()

    def keys(self) -> DataFrame:
        return self.df.select(self.outer_key).distinct()

    def open(self, key: Any) -> Any:
        """The inner structure of a key, over its rows alone; reading makes nothing."""
        return self.inner(self.df.where(F.col(self.outer_key) == F.lit(key)).drop(self.outer_key), *self.options)

    def write_back(self, key: Any, inner: Any) -> Nested:
        """A changed inner structure in the place of the key's rows."""
        rest = self.df.where((F.col(self.outer_key) != F.lit(key)) | F.col(self.outer_key).isNull())
        new = inner.df.withColumn(self.outer_key, F.lit(key).cast(self.df.schema[self.outer_key].dataType))
        return replace(self, df=rest.unionByName(new.select(*self.df.columns)))

    def to_ref(self, key: Any) -> dict[str, Any]:
        """What names an inner structure: enough for from_ref to open it again."""
        return {"outer": self.outer_key, "key": key, "inner": self.inner.__name__}

    def from_ref(self, ref: dict[str, Any]) -> Any:
        if ref.get("outer") != self.outer_key or ref.get("inner") != self.inner.__name__:
            raise SchemaError("a reference of another structure")
        return self.open(ref["key"])


def regrouped(df: DataFrame, outer_key: str, order: str, fields: list[str]) -> DataFrame:
    """One row for each outer key with its rows in order."""
    return df.groupBy(outer_key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("items"))
