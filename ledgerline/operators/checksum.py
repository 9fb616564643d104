"""Order-independent checksums of key ranges."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canon import PRECISION, column, hash_sum, row_hash


def hashed(df: DataFrame, pk: list[str], compare: list[str], p: int = PRECISION) -> DataFrame:
    """(pk..., row_hash); rows with a null key part are left out."""
    whole = functools.reduce(operator.and_, (column(c).isNotNull() for c in pk))
    return df.where(whole).select(*map(column, pk), row_hash(df, [*pk, *compare], p).alias("row_hash"))


def checksum(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., rows, checksum) of hashed rows: one partial and one final aggregation."""
    return rows.groupBy(*map(column, by)).agg(F.count(F.lit(1)).alias("rows"), hash_sum("row_hash").alias("checksum"))
