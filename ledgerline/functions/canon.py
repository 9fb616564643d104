"""Canonical text: values are equal if their canonical texts are. Needs ANSI mode (the default) for decimals."""

from __future__ import annotations

import decimal
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the row hash.
SEPARATOR, NULL, HEX_DIGITS, MODULUS, PRECISION = "\x1f", "\\N", 15, decimal.Decimal(2**63), 17

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class UnsupportedType(ValueError):
    """A column of a nested type has no canonical text; exclude it."""


def _general(p: int):
    """C's ``%.{p}g``, which no built-in function gives; nulls stay null, unlike in pandas."""

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        form = f".{p}g"
        return pa.array([None if v is None else format(v, form) for v in values.to_pylist()], pa.string())

    return text


def canon(col: Column, kind: T.DataType, p: int = PRECISION) -> Column:
    """The canonical text of a value, null for null."""
    if isinstance(kind, T.BooleanType):
        return col.cast("int").cast("string")
    if isinstance(kind, T.DecimalType):
        text = col.cast("string")
        return text if kind.scale == 0 else F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _general(p)(col.cast("double"))
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.TimestampType):
        return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(col))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise UnsupportedType(f"no canonical text for {kind.simpleString()}")
    return col.cast("string")


def column(name: str) -> Column:
    """The column of exactly this name, dots and all; names with backticks Spark can't address."""
    return F.col(f"`{name}`")


def row_hash(df: DataFrame, columns: list[str], p: int = PRECISION) -> Column:
    """The first 60 bits of the MD5 of the columns' canonical texts, in the order given."""
    texts = [F.coalesce(canon(column(c), df.schema[c].dataType, p), F.lit(NULL)) for c in columns]
    digest = F.md5(F.concat_ws(SEPARATOR, *texts))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long")


def hash_parts(name: str) -> list[Column]:
    """Three parts of 20 bits, whose sums are longs for up to 2**43 rows: no decimal is added row by row."""
    low = F.lit((1 << 20) - 1)
    return [F.shiftright(name, 40), F.shiftright(name, 20).bitwiseAND(low), F.col(name).bitwiseAND(low)]


def hash_total(*sums: Column | str) -> Column:
    """The sums of the parts as one sum modulo 2**63."""
    wide = [(F.col(x) if isinstance(x, str) else x).cast("decimal(38,0)") for x in sums]
    total = wide[0] * F.lit(1 << 40).cast("decimal(13,0)") + wide[1] * F.lit(1 << 20).cast("decimal(7,0)") + wide[2]
    return F.pmod(total, F.lit(MODULUS).cast("decimal(20,0)")).cast("long")


def hash_sum(name: str) -> Column:
    """Sum of hashes modulo 2**63, in any order; 0 for no rows."""
    return F.coalesce(hash_total(*(F.sum(part) for part in hash_parts(name))), F.lit(0).cast("long"))
