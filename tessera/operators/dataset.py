"""A table of records with row ids and soft deletion, handles of records, and a heap of raw bytes."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Deleted, NotFound, SchemaError, WrongOwner
from ..session import numbered

ID, GONE = "_addr", "_deleted"


def addressed(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """With row ids, unique and increasing within partitions; with `order`, increasing in it."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return df.withColumn(ID, F.monotonically_increasing_id()).withColumn(GONE, F.lit(False))


@dataclass(frozen=True)
class Ref:
    """A handle of a record: its structure, and its key or row id there. A change gives the changed structure."""

    owner: Any
    key: Any

    def get(self, field: str | None = None) -> Any:
        record = self.owner.record(self.key)
        if field is None:
            return record
        if field not in record:
            raise SchemaError(field)
        return record[field]

    __getitem__ = get

    def update(self, **changes: Any) -> Any:
        return self.owner.set_fields(self.key, **changes)

    def set(self, field: str, value: Any) -> Any:
        return self.update(**{field: value})


@dataclass(frozen=True)
class Dataset:
    df: DataFrame
    name: str = ""

    def live(self) -> DataFrame:
        return self.df.where(~F.col(GONE))

    def _addr(self, at: int | Ref) -> int:
        """A row id, or that of a handle of this dataset."""
        if isinstance(at, Ref):
            if not isinstance(at.owner, Dataset) or at.owner.name != self.name:
                raise WrongOwner(f"a handle of {getattr(at.owner, 'name', at.owner)!r}, not of {self.name!r}")
            return at.key
        return at

    def insert(self, records: DataFrame, order: str | None = None) -> tuple[Dataset, DataFrame]:
        """(the dataset with the records, their row ids): ids go on from the greatest, in `order` or in place."""
        last = self.df.agg(F.max(ID)).first()[0]
        given = records.withColumn("__order", F.col(order) if order else F.monotonically_increasing_id())
        new = numbered(given, ["__order"], ID, 0 if last is None else last + 1).withColumn(GONE, F.lit(False))
        return replace(self, df=self.df.unionByName(new.select(*self.df.columns))), new.select(ID)

    def insert_one(self, **fields: Any) -> tuple[Dataset, Ref]:
        if unknown := set(fields) - set(self.df.columns):
            raise SchemaError(f"unknown fields {sorted(unknown)}")
        last = self.df.agg(F.max(ID)).first()[0]
        addr = 0 if last is None else last + 1
        row = self.df.sparkSession.range(1).select(*[F.lit({**fields, ID: addr, GONE: False}.get(f.name)).cast(f.dataType).alias(f.name) for f in self.df.schema.fields])
        out = replace(self, df=self.df.unionByName(row))
        return out, Ref(out, addr)

    def ref(self, addr: int) -> Ref:
        return Ref(self, addr)

    def read(self, addr: int | Ref) -> DataFrame:
        return self.live().where(F.col(ID) == self._addr(addr))

    def record(self, addr: int | Ref) -> dict[str, Any]:
        got = self.df.where(F.col(ID) == self._addr(addr)).limit(1).collect()
        if not got:
            raise NotFound(addr)
        if got[0][GONE]:
            raise Deleted(addr)
        return {k: v for k, v in got[0].asDict(True).items() if k not in (ID, GONE)}

    def exists(self, addrs: DataFrame) -> DataFrame:
        """The row ids of the first column with `exists` and `is_deleted`."""
        asked = addrs.select(F.col(addrs.columns[0]).alias(ID)).distinct()
        return asked.join(self.df.select(ID, GONE), ID, "left").select(ID, F.coalesce(~F.col(GONE), F.lit(False)).alias("exists"), F.coalesce(GONE, F.lit(False)).alias("is_deleted"))

    def read_many(self, addr: int, count: int) -> DataFrame:
        """A run of records from one on, deleted ones marked by `valid`."""
        return self.df.where(F.col(ID) >= addr).orderBy(ID).limit(count).withColumn("valid", ~F.col(GONE)).drop(GONE)

    def fields(self, *names: str) -> DataFrame:
        return self.live().select(ID, *names)

    def set_fields(self, addr: int | Ref, **changes: Any) -> Dataset:
        if unknown := set(changes) - set(self.df.columns) | ({ID, GONE} & set(changes)):
            raise SchemaError(f"can't set {sorted(unknown)}")
        addr = self._addr(addr)
        self.record(addr)
        return replace(self, df=self.df.withColumns({f: F.when(F.col(ID) == addr, F.lit(v).cast(self.df.schema[f].dataType)).otherwise(F.col(f)) for f, v in changes.items()}))

    def write(self, addr: int | Ref, **record: Any) -> Dataset:
        """The whole record anew: fields that aren't given are null."""
        return self.set_fields(addr, **{f: record.get(f) for f in self.df.columns if f not in (ID, GONE)}, **{k: v for k, v in record.items() if k not in self.df.columns})

    def write_many(self, records: DataFrame) -> Dataset:
        """Records over those of the same row id; deleted ones and those of unknown ids are passed over."""
        new = records.select(*[c for c in self.df.columns if c != GONE]).join(self.live().select(ID), ID, "left_semi").withColumn(GONE, F.lit(False))
        return replace(self, df=self.df.join(new.select(ID), ID, "left_anti").unionByName(new))

    def write_field(self, addr: int | Ref, name: str, value: Any) -> Dataset:
        if name not in self.df.columns:
            raise SchemaError(name)
        return self.set_fields(addr, **{name: value})

    def delete(self, addrs: DataFrame) -> Dataset:
        gone = addrs.select(F.col(addrs.columns[0]).alias(ID), F.lit(True).alias("__g")).distinct()
        return replace(self, df=self.df.join(gone, ID, "left").withColumn(GONE, F.col(GONE) | F.col("__g").isNotNull()).select(*self.df.columns))


@dataclass(frozen=True)
class Blobs:
    """Raw bytes by id: (blob_id, data). Parquet compresses them by its codec."""

    df: DataFrame

    def write(self, data: bytes) -> tuple[Blobs, int]:
        last = self.df.agg(F.max("blob_id")).first()[0]
        new = 0 if last is None else last + 1
        row = self.df.sparkSession.createDataFrame([(new, bytearray(data))], "blob_id long, data binary")
        return replace(self, df=self.df.unionByName(row)), new

    def write_many(self, blobs: DataFrame, column: str, order: str) -> Blobs:
        last = self.df.agg(F.max("blob_id")).first()[0]
        new = numbered(blobs.select(F.col(column).cast("binary").alias("data"), F.col(order).alias("__order")), ["__order"], "blob_id", 0 if last is None else last + 1)
        return replace(self, df=self.df.unionByName(new.select("blob_id", "data")))

    def read(self, blob_id: int) -> bytes:
        got = self.df.where(F.col("blob_id") == blob_id).limit(1).collect()
        if not got:
            raise NotFound(blob_id)
        return bytes(got[0]["data"])

    def delete(self, blob_id: int) -> Blobs:
        self.read(blob_id)
        return replace(self, df=self.df.where(F.col("blob_id") != blob_id))
