"""Filters: watermark cutoffs, half-open key ranges, key sets."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import column


def _all(parts: list[Column]) -> Column:
    return functools.reduce(operator.and_, parts) if parts else F.lit(True)


def literal(df: DataFrame, column: str, value) -> Column:
    """``value`` as the column's type; an aware time becomes naive UTC for a column without zone."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType) and getattr(value, "tzinfo", None):
        import datetime

        value = value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return F.lit(value).cast(kind)


def settled(df: DataFrame, watermark: str | None, cutoff) -> DataFrame:
    """Rows at or below the cutoff; rows without a watermark value aren't among them. No cutoff, no filter."""
    return df if not watermark or cutoff is None else df.where(column(watermark) <= literal(df, watermark, cutoff))


def in_flight(df: DataFrame, pk: list[str], watermark: str | None, cutoff) -> DataFrame:
    """Keys above the cutoff."""
    if not watermark or cutoff is None:
        return df.select(*map(column, pk)).where(F.lit(False))
    return df.where(column(watermark) > literal(df, watermark, cutoff)).select(*map(column, pk))


def _beyond(df: DataFrame, pk: list[str], bound: tuple, below: bool) -> Column:
    """key >= bound, or key < bound, spelled out column by column so that it reaches the scan."""
    out = F.lit(False) if below else F.lit(True)
    for c, v in reversed(list(zip(pk, bound))):  # a shorter bound compares its own columns only
        col, v = column(c), literal(df, c, v)
        out = (col < v) | ((col == v) & out) if below else (col > v) | ((col == v) & out)
    return out


def in_range(df: DataFrame, pk: list[str], lo: tuple | None = None, hi: tuple | None = None) -> DataFrame:
    """Rows whose key lies in [lo, hi), compared as tuples; None is unbounded."""
    parts = []
    if lo is not None:  # the first column alone bounds too: files are pruned by it
        parts += [column(pk[0]) >= literal(df, pk[0], lo[0]), _beyond(df, pk, lo, False)]
    if hi is not None:
        parts += [column(pk[0]) <= literal(df, pk[0], hi[0]), _beyond(df, pk, hi, True)]
    return df.where(_all(parts)) if parts else df


def with_keys(df: DataFrame, keys: DataFrame, pk: list[str]) -> DataFrame:
    """Rows whose key is among ``keys``. Spark broadcasts the keys if it knows them to be few."""
    return df.join(keys.select(*map(column, pk)).distinct(), pk, "left_semi")
