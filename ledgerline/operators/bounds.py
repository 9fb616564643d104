"""Key bounds, integer splits and percentile splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import column


def _known(df: DataFrame, pk: list[str]) -> DataFrame:
    """(key) as a struct, of rows whose key has no null part."""
    keys = df.select(F.struct(*(column(c).alias(c) for c in pk)).alias("key"))
    for c in pk:
        keys = keys.where(F.col("key").getField(c).isNotNull())
    return keys


def pk_bounds(df: DataFrame, pk: list[str]) -> tuple[tuple, tuple] | None:
    """The smallest and largest key, both inclusive, in one pass; None without rows. Rows with a null key part don't count."""
    row = _known(df, pk).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    return None if row["lo"] is None else (tuple(row["lo"]), tuple(row["hi"]))


def boundaries(lo: int, hi: int, fanout: int) -> list[int]:
    """Edges of at most ``fanout`` equal parts of [lo, hi), ends included."""
    n = max(2, fanout)
    return sorted({lo + (hi - lo) * i // n for i in range(n + 1)})


def child(place: Column, lo: Column, hi: Column, fanout: int, wide: bool = False) -> tuple[Column, Column]:
    """The part of [lo, hi) that ``place`` falls into, in closed form: no boundary table, no range join."""
    n, kind = max(2, fanout), "decimal(38,0)" if wide else "long"
    place, lo, hi = place.cast(kind), lo.cast(kind), hi.cast(kind)
    span = hi - lo
    i = F.floor(((place - lo + 1) * n - 1) / span) if wide else F.call_function("div", (place - lo + 1) * n - 1, span)
    edge = (lambda k: F.floor(span * k / n)) if wide else (lambda k: F.call_function("div", span * k, F.lit(n)))
    return (lo + edge(i)).cast("long"), (lo + edge(i + 1)).cast("long")


def split_points(df: DataFrame, pk: list[str], n: int) -> DataFrame:
    """At most n - 1 interior keys, increasing, that part the rows into n nearly equal runs: those of
    rank total * i // n, but for the smallest key.

    Keys are range-sorted; each range numbers its own rows, and only the ranges' sizes and the points reach the driver.
    """
    keys = _known(df, pk).orderBy("key").withColumn("at", F.monotonically_increasing_id()).persist()
    part, sizes = F.shiftright("at", 33), []
    for r in keys.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).orderBy("part").collect():
        sizes.append((r["part"], r["n"], r["least"]))
    total, before, wanted = sum(size for _, size, _ in sizes), 0, []
    ranks = sorted({total * i // n for i in range(1, n)})
    for k, size, _ in sizes:
        wanted += [(k << 33) + rank - before for rank in ranks if before <= rank < before + size]
        before += size
    lowest = sizes[0][2] if sizes else None
    found = {r["key"] for r in keys.where(F.col("at").isin(wanted)).select("key").collect()} - {lowest} if wanted else set()
    keys.unpersist()
    schema = df.select(*map(column, pk)).schema
    return df.sparkSession.createDataFrame(sorted(map(tuple, found)), schema)
