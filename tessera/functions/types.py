"""Field types by name, zero values, and checks on write."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError

_PLAIN = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "bool": T.BooleanType(),
    "text": T.StringType(), "json": T.StringType(), "blob": T.BinaryType(), "datetime": T.TimestampNTZType(),
}
_LIMITS = {"uint8": 2**8, "uint16": 2**16, "uint32": 2**32, "uint64": 2**64}


def data_type(name: str) -> T.DataType:
    """The Spark type of a field type: 'int64', 'U20', 'utf8[16]' (cut), 'utf8[16!]' (refused if longer), 'float32[8]', 'text', 'json', 'blob', 'datetime'."""
    if name in _PLAIN:
        return _PLAIN[name]
    if m := re.fullmatch(r"U(\d+)|utf8\[(\d+)!?\]", name):
        if int(m[1] or m[2]) == 0:
            raise SchemaError(f"{name}: no width")
        return T.StringType()
    if (m := re.fullmatch(r"(\w+)\[(\d+(?:,\d+)*)\]", name)) and m[1] in _PLAIN and m[1] not in ("text", "json", "blob", "datetime"):
        out = _PLAIN[m[1]]
        for _ in m[2].split(","):
            out = T.ArrayType(out)
        return out
    raise SchemaError(f"unknown field type {name}")


def struct(fields: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(k, data_type(v)) for k, v in fields.items()])


def zero(name: str) -> Column:
    """What a field has that isn't given."""
    kind = data_type(name)
    if isinstance(kind, T.StringType):
        return F.lit(None).cast("string") if name == "json" else F.lit("")
    if isinstance(kind, T.TimestampNTZType):
        return F.lit("1970-01-01").cast("timestamp_ntz")
    if isinstance(kind, T.BinaryType):
        return F.lit(None).cast("binary")
    if isinstance(kind, T.ArrayType):
        value = F.lit(0).cast(_PLAIN[name.split("[")[0]])
        for n in reversed(name.split("[")[1][:-1].split(",")):
            value = F.array_repeat(value, int(n))
        return value
    return F.lit(False) if name == "bool" else F.lit(0).cast(kind)


def cut_bytes(value: Column, n: int) -> Column:
    """The longest prefix of at most n bytes that ends between characters: all JVM-side."""
    lead = F.filter(F.sequence(F.lit(0), F.least(F.lit(n), F.length(value))), lambda k: F.octet_length(F.substring(value, F.lit(1), k)) <= n)
    return F.when(F.octet_length(value) <= n, value).otherwise(F.substring(value, F.lit(1), F.array_max(lead)))


def stored(value: Column, name: str) -> Column:
    """A value as its field stores it; raises at run time where a strict field overflows."""
    if m := re.fullmatch(r"U(\d+)", name):
        return F.substring(value.cast("string"), 1, int(m[1]))
    if m := re.fullmatch(r"utf8\[(\d+)(!?)\]", name):
        n = int(m[1])
        if m[2]:
            return F.when(F.octet_length(value) > n, F.raise_error(F.lit(f"longer than {n} bytes"))).otherwise(value)
        return cut_bytes(value.cast("string"), n)
    if name in _LIMITS:
        return F.when((value < 0) | (value >= F.lit(str(_LIMITS[name])).cast("decimal(20,0)")), F.raise_error(F.lit(f"beyond {name}"))).otherwise(value.cast(_PLAIN[name]))
    kind = data_type(name)
    if isinstance(kind, T.ArrayType) and "," not in name:
        n = int(name.split("[")[1][:-1])
        return F.when(F.size(value) != n, F.raise_error(F.lit(f"not {n} numbers"))).otherwise(value.cast(kind))
    return value.cast(kind)


def conformed(df: DataFrame, fields: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """df with the declared fields: unknown ones are refused, missing and null ones get zeros."""
    if unknown := set(df.columns) - set(fields) - set(keep):
        raise SchemaError(f"unknown fields {sorted(unknown)}")
    return df.select(*keep, *[F.coalesce(stored(F.col(k), v), zero(v)).alias(k) if k in df.columns else zero(v).alias(k) for k, v in fields.items()])


PRECISIONS = {"year": "yyyy", "month": "yyyyMM", "day": "yyyyMMdd", "hour": "yyyyMMddHH", "minute": "yyyyMMddHHmm", "second": "yyyyMMddHHmmss", "microsecond": "yyyyMMddHHmmssSSSSSS"}


def dt_key(value: Column, precision: str = "second") -> Column:
    """A datetime as a sortable string."""
    return F.date_format(value, PRECISIONS[precision])


def key_dt(key: Column, precision: str = "second") -> Column:
    return F.to_timestamp_ntz(key, F.lit(PRECISIONS[precision]))


def descending(column: Column, kind: T.DataType) -> Column:
    """Order from high to low; among strings a prefix stays before what extends it."""
    return F.concat(column, F.lit("\U0010ffff")).desc() if isinstance(kind, T.StringType) else column.desc()
