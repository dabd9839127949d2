"""A typed record collection: declared access paths become filters and orders, so nothing is kept up on write.

Every method returns a DataFrame (or a new Collection, for changes). An index is a declaration: it says what
may be asked and in what order the answer comes. Catalyst pushes the filters and columns to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotFound, SchemaError, UniqueViolation
from ..functions.types import descending
from ..session import last_of
from . import fulltext, vectors
from .dataset import Ref
from .structures import _column, _row


@dataclass(frozen=True)
class Unique:
    field: str


@dataclass(frozen=True)
class Range:
    field: str


@dataclass(frozen=True)
class Many:
    field: str
    sort: str | None = None
    desc: bool = False
    counted: bool = False


@dataclass(frozen=True)
class Search:
    fields: tuple[str, ...]
    scoring: str = "boolean"
    k1: float = 1.5
    b: float = 0.75


@dataclass(frozen=True)
class Vector:
    field: str
    metric: str = "cosine"


Index = Unique | Range | Many | Search | Vector
Where = dict[str, Any] | Column | Callable[[dict], bool] | None


@dataclass(frozen=True)
class Collection:
    """df: the records; primary: the key field; ties are broken by the key as a string."""

    df: DataFrame
    primary: str
    indexes: dict[str, Index]

    def __post_init__(self) -> None:
        kinds = {f.name: f.dataType for f in self.df.schema.fields}
        if self.primary not in kinds:
            raise SchemaError(f"no primary field {self.primary}")
        for name, ix in self.indexes.items():
            fields = list(ix.fields) if isinstance(ix, Search) else [ix.field] + ([ix.sort] if isinstance(ix, Many) and ix.sort else [])
            if missing := [f for f in fields if f not in kinds]:
                raise SchemaError(f"index {name}: no field {missing}")
            ordered = [ix.field] if isinstance(ix, Range) else [ix.sort] if isinstance(ix, Many) and ix.sort else []
            if any(isinstance(kinds[f], T.BinaryType | T.ArrayType | T.MapType | T.StructType) for f in ordered):
                raise SchemaError(f"index {name}: {ordered[0]} has no order")
            if isinstance(ix, Many) and ix.counted and isinstance(kinds[ix.field], T.TimestampNTZType | T.TimestampType):
                raise SchemaError(f"index {name}: datetimes can't be counted")
            if isinstance(ix, Vector) and (not isinstance(kinds[ix.field], T.ArrayType) or ix.metric not in vectors.METRICS):
                raise SchemaError(f"index {name}: not a vector, or no such metric")

    def _index(self, name: str, *kinds: type) -> Any:
        ix = self.indexes.get(name)
        if not isinstance(ix, kinds):
            raise SchemaError(f"{name} isn't an index of kind {'/'.join(k.__name__ for k in kinds)}")
        return ix

    def _kind(self, field: str) -> T.DataType:
        return self.df.schema[field].dataType

    def _literal(self, field: str, value: Any) -> Column:
        """A literal of the field's kind; a float for a whole-number field is cut."""
        kind = self._kind(field)
        if isinstance(value, str) and not isinstance(kind, T.StringType):
            return F.lit(value).try_cast(kind)
        return F.lit(int(value)).cast(kind) if isinstance(kind, T.IntegralType) and isinstance(value, float) else F.lit(value).cast(kind)

    @property
    def _tie(self) -> Column:
        return F.col(self.primary).cast("string")

    def _answer(self, df: DataFrame, order: Sequence[Column], limit: int | None, fields: Sequence[str] | None) -> DataFrame:
        df = df.orderBy(*order)
        df = df if limit is None else df.limit(limit)
        return df.select(*fields) if fields else df

    # reads

    def get_primary(self, key: Any) -> DataFrame:
        return self.df.where(F.col(self.primary) == self._literal(self.primary, key))

    def record(self, key: Any) -> dict[str, Any]:
        got = self.get_primary(key).limit(1).collect()
        if not got:
            raise NotFound(key)
        return got[0].asDict(True)

    def ref(self, key: Any) -> Ref:
        return Ref(self, key)

    def __contains__(self, key: Any) -> bool:
        return not self.get_primary(key).isEmpty()

    def __len__(self) -> int:
        return self.df.count()

    def __iter__(self) -> Iterator[dict[str, Any]]:
        """Records, not keys."""
        return (r.asDict(True) for r in self.df.toLocalIterator())

    def keys(self) -> DataFrame:
        return self.df.select(self.primary)

    def values(self) -> DataFrame:
        return self.df

    def items(self) -> DataFrame:
        """(key, record)."""
        return self.df.select(F.col(self.primary).alias("key"), F.struct(*self.df.columns).alias("record"))

    def get(self, name: str, value: Any, fields: Sequence[str] | None = None) -> DataFrame:
        ix = self._index(name, Unique)
        df = self.df.where(F.col(ix.field) == self._literal(ix.field, value))
        return df.select(*fields) if fields else df

    def _group(self, ix: Many, value: Any, start: Any, end: Any) -> DataFrame:
        df = self.df.where(F.col(ix.field) == self._literal(ix.field, value))
        if (start is not None or end is not None) and not ix.sort:
            raise SchemaError("bounds need an index with a sort field")
        if start is not None and end is not None:  # bounds come in either order
            a, b = self._literal(ix.sort, start), self._literal(ix.sort, end)
            return df.where(F.col(ix.sort).between(F.least(a, b), F.greatest(a, b)))
        if start is not None or end is not None:
            # one bound: the start in the index's own order
            low = (start is not None) != ix.desc
            bound = self._literal(ix.sort, start if start is not None else end)
            return df.where(F.col(ix.sort) >= bound if low else F.col(ix.sort) <= bound)
        return df

    def _many_order(self, ix: Many) -> list[Column]:
        if not ix.sort:
            return [self._tie]
        return [descending(F.col(ix.sort), self._kind(ix.sort)) if ix.desc else F.col(ix.sort).asc(), self._tie]

    def find(self, name: str, value: Any, start: Any = None, end: Any = None, limit: int | None = None, fields: Sequence[str] | None = None) -> DataFrame:
        """Records of a group, within bounds of the sort field (both included), in its order."""
        ix = self._index(name, Many)
        return self._answer(self._group(ix, value, start, end), self._many_order(ix), limit, fields)

    def top_per_group(self, name: str, n: int, fields: Sequence[str] | None = None) -> DataFrame:
        """The first n records of every group in the index's order: one shuffle by the group."""
        ix = self._index(name, Many)
        df = self.df.where(F.col(ix.field).isNotNull())
        ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(ix.field).orderBy(*self._many_order(ix)))).where(F.col("__rank") <= n)
        return ranked.select(*(fields or self.df.columns))

    def range(self, name: str, low: Any = None, high: Any = None, limit: int | None = None, desc: bool = False, fields: Sequence[str] | None = None) -> DataFrame:
        """Records by value, both bounds included; desc turns values and ties."""
        ix = self._index(name, Range)
        df = self.df.where(F.col(ix.field).isNotNull())
        if low is not None:
            df = df.where(F.col(ix.field) >= self._literal(ix.field, low))
        if high is not None:
            df = df.where(F.col(ix.field) <= self._literal(ix.field, high))
        if desc:
            return self._answer(df, [F.col(ix.field).desc(), self._tie.desc()], limit, fields)
        return self._answer(df, [F.col(ix.field).asc(), self._tie.asc()], limit, fields)

    def first(self, name: str) -> DataFrame:
        return self.range(name, limit=1)

    def latest(self, name: str) -> DataFrame:
        return self.range(name, limit=1, desc=True)

    def count(self, name: str, value: Any, start: Any = None, end: Any = None) -> DataFrame:
        return self._group(self._index(name, Many), value, start, end).agg(F.count("*").alias("n"))

    def groups(self, name: str, order_by: str = "count", desc: bool = True, limit: int | None = None) -> DataFrame:
        """(value, n) of every group; by count, ties by the value as a string, turned as a pair."""
        ix = self._index(name, Many)
        if not ix.counted:
            raise SchemaError("groups needs a counted index")
        df = self.df.where(F.col(ix.field).isNotNull()).groupBy(F.col(ix.field).alias("value")).agg(F.count("*").alias("n"))
        keys = [F.col("n"), F.col("value").cast("string")] if order_by == "count" else [F.col("value")]
        df = df.orderBy(*[k.desc() if desc else k.asc() for k in keys])
        return df if limit is None else df.limit(limit)

    def predicate(self, where: Where) -> Column:
        """{field: value} or {field: (low, high)} (None is open), a Column, or a row function (slow: every row crosses into Python)."""
        if where is None:
            return F.lit(True)
        if isinstance(where, Column):
            return F.coalesce(where, F.lit(False))
        if callable(where):
            return F.udf(lambda row: bool(where(row.asDict(True))), "boolean")(F.struct(*self.df.columns))
        tests = []
        for field, v in where.items():
            if isinstance(v, tuple) and len(v) == 2:
                tests += [F.col(field) >= self._literal(field, v[0])] if v[0] is not None else []
                tests += [F.col(field) <= self._literal(field, v[1])] if v[1] is not None else []
            else:
                tests.append(F.col(field) == self._literal(field, v))
        return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))

    def where(self, where: Where, fields: Sequence[str] | None = None) -> DataFrame:
        df = self.df.where(self.predicate(where))
        return df.select(*fields) if fields else df

    def search(self, name: str, query: str, where: Where = None, mode: str | None = None, limit: int | None = None, with_scores: bool = False, index: fulltext.SearchIndex | None = None) -> DataFrame:
        """Full text: ranked over all records first, then filtered, then cut. With a stored index only the query's terms are read, and the records that hold them."""
        ix = self._index(name, Search)
        mode = mode or ix.scoring
        if with_scores and mode == "boolean":
            raise SchemaError("a boolean search has no scores")
        if index is None:
            hits = fulltext.search(self.df, query, self.primary, ix.fields, mode, ix.k1, ix.b)
        else:
            found = index.search(query, mode, ix.k1, ix.b)
            hits = self.df.join(found.withColumnRenamed("doc_id", self.primary), self.primary)
        hits = hits.where(self.predicate(where))
        order = [F.col("score").desc(), F.col(self.primary)] if mode != "boolean" else [F.col(self.primary)]
        hits = hits.orderBy(*order)
        hits = hits if limit is None else hits.limit(limit)
        return hits if with_scores else hits.drop("score")

    def candidates(self, where: Where) -> tuple[int, str]:
        """How a vector search narrows its candidates, for people: the rank and the index. 3: a group and bounds of its sort field, 2: a unique field or a group, 1: a range, 0: a scan. Catalyst pushes the filter down in any case."""
        fields = where if isinstance(where, dict) else {}
        best = (0, "scan")
        for name, ix in self.indexes.items():
            v = fields.get(getattr(ix, "field", None))
            equal = v is not None and not isinstance(v, tuple)
            if isinstance(ix, Many) and equal:
                best = max(best, (3 if ix.sort and isinstance(fields.get(ix.sort), tuple) else 2, name))
            elif isinstance(ix, Unique) and equal:
                best = max(best, (2, name))
            elif isinstance(ix, Range) and v is not None:
                best = max(best, (1, name))
        return best

    def nearest(self, name: str, query: Sequence[float], k: int = 10, where: Where = None, fields: Sequence[str] | None = None) -> DataFrame:
        """Exact nearest records after the filter; score is a distance for l2, else a similarity."""
        ix = self._index(name, Vector)
        df = self.df.where(self.predicate(where)).withColumn("score", vectors.score(F.col(ix.field), query, ix.metric))
        df = df.orderBy(F.col("score").asc() if ix.metric == "l2" else F.col("score").desc(), self._tie).limit(k)
        return df.select(*fields, "score") if fields else df

    # changes: each gives a new Collection

    def _with(self, df: DataFrame) -> Collection:
        return replace(self, df=df)

    def insert(self, **fields: Any) -> Collection:
        """One record, over that of the same key; fields that aren't given are null."""
        if fields.get(self.primary) is None:
            raise SchemaError(f"no {self.primary}")
        return self.insert_many(_row(self.df, fields))

    def insert_many(self, records: DataFrame, order: str | None = None, check: bool = True) -> Collection:
        """Records put in or put over those of the same key; of records with one key the last by `order`, or else by place, wins. Unique fields are checked before anything is taken over."""
        new = last_of(records, [self.primary], order).select(*self.df.columns)
        kept = self.df.join(new.select(F.col(self.primary).alias("__key")), F.col(self.primary) == F.col("__key"), "left_anti")
        out = self._with(kept.unionByName(new))
        if check and any(isinstance(ix, Unique) for ix in self.indexes.values()) and (bad := out.violations().limit(1).collect()):
            raise UniqueViolation(f"{bad[0]['field']} = {bad[0]['value']}")
        return out

    def _hit(self, keys: Sequence[Any], missing: str) -> Column:
        """Whether a record's key is one of `keys`; one that no record has is an error, unless missing is 'ignore'."""
        if missing == "raise":
            self._refuse(_column(self.df, self.primary, list(keys)))
        return F.col(self.primary).isin([self._literal(self.primary, k) for k in keys])

    def _refuse(self, keys: DataFrame) -> None:
        if bad := keys.join(self.df, self.primary, "left_anti").limit(1).collect():
            raise NotFound(bad[0][0])

    def update(self, keys: Sequence[Any], missing: str = "raise", **changes: Any) -> Collection:
        """Fields set where the key is one of `keys`; values may be Columns. A key that isn't there is an error, unless missing is 'ignore'."""
        if self.primary in changes:
            raise SchemaError("the key can't change")
        if unknown := set(changes) - set(self.df.columns):
            raise SchemaError(f"unknown fields {sorted(unknown)}")
        hit = self._hit(keys, missing)
        return self._with(self.df.withColumns({f: F.when(hit, (v if isinstance(v, Column) else F.lit(v)).cast(self._kind(f))).otherwise(F.col(f)) for f, v in changes.items()}))

    def set_fields(self, key: Any, **changes: Any) -> Collection:
        return self.update([key], **changes)

    def increment(self, keys: Sequence[Any], field: str, amount: int | float = 1, missing: str = "raise") -> Collection:
        return self.update(keys, missing, **{field: F.col(field) + F.lit(amount)})

    def delete(self, keys: DataFrame | Sequence[Any], missing: str = "raise") -> Collection:
        """Without the keys: a list, or a DataFrame with the key field. A key that isn't there is an error, unless missing is 'ignore'."""
        if isinstance(keys, DataFrame):
            gone = _column(self.df, self.primary, keys.select(self.primary))
            if missing == "raise":
                self._refuse(gone)
            return self._with(self.df.join(gone, self.primary, "left_anti").select(*self.df.columns))
        return self._with(self.df.where(~self._hit(keys, missing)))

    def violations(self) -> DataFrame:
        """(field, value, n) of unique fields' values that more than one record has."""
        parts = [self.df.where(F.col(f).isNotNull()).groupBy(F.col(f).cast("string").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(f).alias("field"), "value", "n") for f in [self.primary, *[ix.field for ix in self.indexes.values() if isinstance(ix, Unique)]]]
        return reduce(DataFrame.unionByName, parts)

    def migrate(self, fields: dict[str, Column], indexes: dict[str, Index] | None = None) -> Collection:
        """Fields made anew from the old ones."""
        return Collection(self.df.select(*[c.alias(k) for k, c in fields.items()]), self.primary, self.indexes if indexes is None else indexes)

    def sample(self, n: int, seed: int | None = 0) -> DataFrame:
        """n records: by a hash of the key and the seed, whatever the partitioning; without a seed the first by key."""
        return self.df.orderBy(F.xxhash64(self._tie, F.lit(seed)) if seed is not None else self._tie, self._tie).limit(n)

    def describe(self, n: int = 3, seed: int = 0) -> str:
        """A few lines for people; runs two small jobs."""
        lines = [f"{self.df.count()} records, key {self.primary}"] + [f"  {f.name}: {f.dataType.simpleString()}" for f in self.df.schema.fields] + [f"  index {k}: {v}" for k, v in self.indexes.items()]
        return "\n".join(lines + [str(r.asDict()) for r in self.sample(n, seed).collect()])


def dangling(child: DataFrame, field: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no record."""
    return child.where(F.col(field).isNotNull()).join(parent.select(F.col(key).alias("__key")), F.col(field) == F.col("__key"), "left_anti")
