"""One comparison from its configuration to its report."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import column
from ..operators import diff as d
from ..operators.checksum import hashed
from ..operators.lag import cutoff as cutoff_of
from ..operators.lag import recheck
from ..operators.predicates import in_flight, settled
from .config import Comparison
from .report import Report

Loader = Callable[[], DataFrame]


def resolved(df: DataFrame, names: list[str]) -> list[str]:
    """The columns' own spelling, whatever the case asked for."""
    own = {c.lower(): c for c in df.columns}
    if lacking := [n for n in names if n.lower() not in own]:
        raise ValueError(f"no such columns: {', '.join(lacking)}")
    return [own[n.lower()] for n in names]


def compared_columns(source: DataFrame, target: DataFrame, pk: list[str], listed: list[str] | None, excluded: list[str]) -> list[str]:
    """The columns listed, or those that both sides have; without key and excluded ones; sorted, in lower case."""
    shared = {c.lower() for c in source.columns} & {c.lower() for c in target.columns}
    chosen = {c.lower() for c in listed} if listed is not None else shared
    return sorted(chosen - {c.lower() for c in [*pk, *excluded]})


def lowered(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def _whole_digits(kind: T.DataType) -> tuple[int, int] | None:
    """Digits before and behind the point that a type may have."""
    if isinstance(kind, T.DecimalType):
        return kind.precision - kind.scale, kind.scale
    return {"byte": (3, 0), "short": (5, 0), "integer": (10, 0), "long": (19, 0)}.get(kind.typeName())


def _common(a: T.DataType, b: T.DataType) -> str | None:
    """A type that holds the keys of both exactly, so that equal keys are equal and hash alike."""
    names, digits = {a.typeName(), b.typeName()}, [_whole_digits(a), _whole_digits(b)]
    if all(digits):
        before, behind = (max(x) for x in zip(*digits))
        if not behind and before <= 19 and not any(isinstance(x, T.DecimalType) for x in (a, b)):
            return "long"
        return f"decimal({before + behind},{behind})" if before + behind <= 38 else None
    if names <= {"float", "double"}:
        return "double"
    if names <= {"date", "timestamp", "timestamp_ntz"}:
        return "timestamp_ntz"
    return "string" if names <= {"string", "char", "varchar"} else None


def _alike(source: DataFrame, target: DataFrame, pk: list[str]) -> tuple[DataFrame, DataFrame]:
    """Key columns of both sides in a common type: equal numbers are equal keys, 1 as well as 1.00; times are UTC. Types
    without one, such as text and numbers, are refused: compared as text they would drift where nothing does."""
    for c in pk:
        a, b = source.schema[c].dataType, target.schema[c].dataType
        if a != b:
            if not (kind := _common(a, b)):
                raise ValueError(f"key {c} is {a.simpleString()} here and {b.simpleString()} there; cast one side")
            source, target = (df.withColumn(c, _cast(column(c), df.schema[c].dataType, kind)) for df in (source, target))
    return source, target


def _cast(col: Column, own: T.DataType, kind: str) -> Column:
    if kind == "timestamp_ntz" and isinstance(own, T.TimestampType):
        col = F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast(kind))
    return col.cast(kind)


def compare(source: Loader, target: Loader, cmp: Comparison, now: datetime.datetime | None = None, sleep: Callable[[float], None] = time.sleep) -> Report:
    """Reconcile what two loaders give. Errors pass through to the caller.

    Each side is read once, hashed rows being kept until the drift is known, and once more a recheck; a source
    that changes meanwhile should be loaded at a pinned version or snapshot.
    """
    began = time.monotonic()
    pk = [c.lower() for c in cmp.primary_key]
    wm = cmp.watermark_column.lower() if cmp.watermark_column else None

    def load() -> tuple[DataFrame, DataFrame]:
        return _alike(lowered(source()), lowered(target()), pk)

    a, b = load()
    columns = compared_columns(a, b, pk, cmp.compare_columns, cmp.exclude_columns)
    cut = cutoff_of(wm, cmp.grace_seconds, now)

    def rows(df: DataFrame, at) -> DataFrame:
        return hashed(settled(df, wm, at), pk, columns, cmp.float_precision)

    left, right = rows(a, cut), rows(b, cut)
    flying = in_flight(a, pk, wm, cut) if wm else None
    if cmp.strategy == "join":
        walk = d.joined(left, right, pk, flying)
    else:
        walk = d.walk(left, right, pk, cmp.segment_fanout, cmp.leaf_size, flying)
    before = walk.drift.count()

    def fresh() -> tuple[DataFrame, DataFrame]:
        a, b = load()
        return rows(a, None), rows(b, None)

    drift = recheck(walk.drift, pk, fresh, cmp.recheck_delay, cmp.recheck_rounds, sleep) if before else walk.drift
    report = Report(cmp.name, drift, pk, walk.rows_compared, walk.segments_scanned, before, cut.isoformat() if cut else None, kept=[*walk.kept, drift])
    report.drift_by_kind  # counted here, so that the time holds it
    report.duration_seconds = time.monotonic() - began
    return report
