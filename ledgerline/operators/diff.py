"""Which keys differ, by one pass over both sides or by segments that agree being left alone."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import column, hash_parts, hash_total
from .bounds import child

MISSING, EXTRA, CHANGED = KINDS = ("missing", "extra", "changed")


def _sides(source: DataFrame, target: DataFrame, pk: list[str]) -> DataFrame:
    """Hashed rows of both sides in one table: (key, row_hash, side); ``key`` is a struct, so its parts may have any name."""
    key = F.struct(*(column(c).alias(c) for c in pk)).alias("key")
    return source.select(key, "row_hash", F.lit(0).alias("side")).unionByName(target.select(key, "row_hash", F.lit(1).alias("side")))


def _largest(side: int) -> Column:
    return F.max(F.when(F.col("side") == side, F.col("row_hash"))).alias(f"m{side}")


def _judged(keys: DataFrame) -> DataFrame:
    """(key, kind) of keys with each side's hash, kind null where both agree."""
    kind = F.when(F.col("m1").isNull(), MISSING).when(F.col("m0").isNull(), EXTRA).when(F.col("m0") != F.col("m1"), CHANGED)
    return keys.select("key", kind.alias("kind"))


def matched(source: DataFrame, target: DataFrame, pk: list[str]) -> DataFrame:
    """Both sides' keys with their kind of drift: (pk..., kind), kind null where both agree.

    One aggregation of both sides together, so repeated keys shrink before the only shuffle and no join is
    needed. Of a key's rows the largest hash speaks for it, so that the choice doesn't hang on their order.
    """
    return _judged(_sides(source, target, pk).groupBy("key").agg(_largest(0), _largest(1))).select("key.*", "kind")


def settled_keys(found: DataFrame, pk: list[str], in_flight: DataFrame | None) -> DataFrame:
    """``found`` without the keys in flight."""
    return found if in_flight is None else found.join(in_flight.distinct(), pk, "left_anti")


def diff(source: DataFrame, target: DataFrame, pk: list[str], in_flight: DataFrame | None = None) -> DataFrame:
    """(pk..., kind) of the keys that differ; keys in flight are left out."""
    return settled_keys(matched(source, target, pk).where(F.col("kind").isNotNull()), pk, in_flight)


@dataclass
class Walk:
    drift: DataFrame
    rows_compared: int
    segments_scanned: int
    kept: list[DataFrame] = field(default_factory=list)  # persisted; to be released with the report


def joined(source: DataFrame, target: DataFrame, pk: list[str], in_flight: DataFrame | None = None) -> Walk:
    found = settled_keys(matched(source, target, pk), pk, in_flight).persist()
    return Walk(found.where("kind IS NOT NULL"), found.count(), 1, [found])


def _weights(side: int) -> list[Column]:
    own = F.col("side") == side
    sums = [F.coalesce(F.sum(F.when(own, part)), F.lit(0)).alias(f"{name}{side}") for name, part in zip("abc", hash_parts("row_hash"), strict=True)]
    return [F.count(F.when(own, 1)).alias(f"n{side}"), *sums]


#: Dirty segments that the driver may hold, to keep plans short; more of them stay a table.
FEW = 20_000
SUMS = [f"{name}{side}" for side in (0, 1) for name in "nabc"]


def _ordered(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(place, key, m0, m1, sums...) of every key, the frame kept for it, and the source's number of rows.

    ``place``: how many source rows lie before the key; a key that only the target has goes by the last source key before
    it. So equal runs of places are equal runs of source rows. Keys are range-sorted once and numbered
    range by range; the driver sees a row a range.
    """
    keys = rows.groupBy("key").agg(_largest(0), _largest(1), *_weights(0), *_weights(1))
    ranged = keys.repartitionByRange("key").withColumn("part", F.spark_partition_id()).persist()
    last = F.max_by("n0", F.when(F.col("n0") > 0, F.col("key"))).alias("last")
    starts, before, carry = [], 0, 0
    for r in ranged.groupBy("part").agg(F.sum("n0").alias("n"), last).orderBy("part").collect():
        starts.append((r["part"], before, carry))
        before += r["n"]
        carry = before - r["last"] if r["last"] else carry
    starts = rows.sparkSession.createDataFrame(starts, "part int, start long, carry long")
    run = Window.partitionBy("part").orderBy("key")
    seen = F.coalesce(F.sum("n0").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.last(F.when(F.col("n0") > 0, F.col("seen")), True).over(run.rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("seen", seen).withColumn("own", own).join(F.broadcast(starts), "part")
    return placed.select(F.coalesce(F.col("own") + F.col("start"), F.col("carry")).alias("place"), "key", "m0", "m1", *SUMS), ranged, before


def _descended(found: DataFrame, depth: int, fan: int, leaf_size: int) -> DataFrame:
    """The finest segments, below open ones, with what becomes of them level by level: ``open`` if the finest itself is dirty and
    large, ``leaf`` if it or a segment above it is dirty and small; ``scans``: the parts of open segments, told once."""
    finest, edges = F.col("lo"), ["lo", "hi", *(f"{x}{k}" for k in range(depth + 1) for x in ("lo", "hi"))]
    out = found.withColumn("open", F.lit(True)).withColumn("leaf", F.lit(False)).withColumn("scans", F.lit(0).cast("long"))
    for k in range(1, depth + 1):
        own, width = Window.partitionBy(f"lo{k}", f"hi{k}"), F.col(f"hi{k}") - F.col(f"lo{k}")
        if k < depth:
            totals, first = [F.sum(c).over(own).alias(f"t{c}") for c in SUMS], F.min(finest).over(own) == finest
        else:
            totals, first = [F.col(c).alias(f"t{c}") for c in SUMS], F.lit(True)
        out = out.select("*", *totals, first.alias("first"), F.greatest(totals[0], totals[4]).alias("most_here"))
        same = (F.col("tn0") == F.col("tn1")) & (hash_total("ta0", "tb0", "tc0") == hash_total("ta1", "tb1", "tc1"))
        dirty, large = F.col("open") & ~same, (F.col("most_here") > leaf_size) & (width > 1)
        out = out.select(
            *edges, *SUMS, (dirty & large).alias("open"), (F.col("leaf") | dirty & ~large).alias("leaf"), F.col("most_here").alias("most"),
            (F.col("scans") + F.when(dirty & large & F.col("first"), F.least(F.lit(fan), width)).otherwise(0)).alias("scans"),
        )
    return out


def _path(df: DataFrame, place: str, depth: int, fan: int, span: int) -> DataFrame:
    """Adds the segments of ``place``, level by level below [lo0, hi0)."""
    for k in range(depth):
        lo, hi = child(F.col(place), F.col(f"lo{k}"), F.col(f"hi{k}"), fan, span * (fan + 1) >= 2**62)
        df, span = df.withColumn(f"lo{k + 1}", lo).withColumn(f"hi{k + 1}", hi), span // fan + 1
    return df


def walk(source: DataFrame, target: DataFrame, pk: list[str], fanout: int = 16, leaf_size: int = 5000, in_flight: DataFrame | None = None) -> Walk:
    """Segments of the key space, whose row count and checksum are compared on both sides: equal ones close, large ones
    split, small ones become leaves, whose rows are compared at the end.

    Keys are read for their bounds, then rows once, and aggregated at once by the finest segments that their number suggests, with
    partial aggregation; the levels above are sums of those sums. Dirty segments stay tables: the driver sees
    counts only, whatever the drift. Where keys leave gaps, what is still too large goes down further, by itself. A single integer
    key is its own place; other keys are sorted and numbered, see ``_ordered``. With one side empty every key drifts.
    """
    rows, fan, frames = _sides(source, target, pk), max(2, fanout), []
    if len(pk) == 1 and isinstance(source.schema[pk[0]].dataType, T.IntegralType):
        table = rows.select(F.col("key").getField(pk[0]).cast("long").alias("place"), "key", "side", "row_hash")
        low, high, n0, n1 = table.agg(F.min("place"), F.max("place"), F.count(F.when(F.col("side") == 0, 1)), F.count(F.when(F.col("side") == 1, 1))).first()
        sums, largest = [*_weights(0), *_weights(1)], [_largest(0), _largest(1)]
    else:
        table, kept, n0 = _ordered(rows)
        frames.append(kept)
        low, high, n1 = 0, n0 - 1, kept.agg(F.coalesce(F.sum("n1"), F.lit(0))).first()[0]
        sums, largest = [F.sum(c).alias(c) for c in SUMS], [F.max(c).alias(c) for c in ("m0", "m1")]

    def ended(segments: int, rows: DataFrame | None, before: bool = False) -> Walk:
        """The walk's end with the rows of all leaves; ``before``: counted before keys in flight go."""
        if rows is None:
            out = Walk(matched(source, target, pk).where(F.lit(False)), 0, segments)
        else:
            found = _judged(rows.groupBy("key").agg(*largest)).select("key.*", "kind")
            found = (found if before else settled_keys(found, pk, in_flight)).persist()
            out = Walk((settled_keys(found, pk, in_flight) if before else found).where("kind IS NOT NULL"), found.count(), segments, [found])
        for frame in frames:
            frame.unpersist()
        return out

    if not (n0 and n1):
        return ended(int(n0 + n1 > 0), table, True)
    size, span, scanned, inside, ends = max(n0, n1), high + 1 - low, 1, [], ["lo0", "hi0", "lo", "hi"]
    level, root, depth = table.withColumn("lo0", F.lit(low).cast("long")).withColumn("hi0", F.lit(high + 1).cast("long")), True, 0
    while size:
        need = math.ceil(math.log(size / leaf_size, fan)) if size > leaf_size else 1
        depth = max(1, need, 2 * depth)  # keys that leave gaps need more levels than their number says
        level = _path(level, "place", depth, fan, span).withColumn("lo", F.col(f"lo{depth}")).withColumn("hi", F.col(f"hi{depth}"))
        level = level.select(*table.columns, *ends).persist()  # joins below see columns, not how they came about
        found = _path(level.groupBy(*ends).agg(*sums), "lo", depth, fan, span).persist()
        frames += [level, found]
        if root:  # one segment: its sums are a row
            whole = found.agg(*(F.sum(c).alias(c) for c in SUMS))
            if whole.select((F.col("n0") == F.col("n1")) & (hash_total("a0", "b0", "c0") == hash_total("a1", "b1", "c1"))).first()[0]:
                return ended(1, None)
            if size <= leaf_size or high == low:
                return ended(1, level)
            scanned, root = 1 + min(fan, high + 1 - low), False
        seen = _descended(found, depth, fan, leaf_size).persist()
        frames.append(seen)
        more, leaves, opened, size = seen.agg(F.sum("scans"), F.count(F.when(F.col("leaf"), 1)), F.count(F.when(F.col("open"), 1)), F.max(F.when(F.col("open"), F.col("most")))).first()
        scanned += more or 0
        dirty = seen.where("leaf OR open").select("lo", "hi", "leaf", "open")
        seen = dirty if leaves + opened > FEW else seen.sparkSession.createDataFrame(dirty.collect(), "lo long, hi long, leaf boolean, open boolean")
        if leaves:
            inside.append(level.join(seen.where("leaf").select("lo", "hi"), ["lo", "hi"], "left_semi").select(*table.columns))
        if size:
            open_ = level.drop("lo0", "hi0").join(seen.where("open").select("lo", "hi"), ["lo", "hi"], "left_semi")
            level = open_.select(*table.columns, F.col("lo").alias("lo0"), F.col("hi").alias("hi0"))
        for _ in range(depth):
            span = span // fan + 1
    return ended(scanned, functools.reduce(DataFrame.unionByName, inside) if inside else None)
