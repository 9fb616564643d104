"""Reports: what a comparison found, as text or JSON, and the exit code."""

from __future__ import annotations

import datetime
import functools
import io
import json
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.diff import KINDS

# Exit codes of the command.
IN_SYNC, DRIFT, FAILED, BAD_CONFIG = 0, 1, 2, 3


@dataclass
class Report:
    comparison: str
    drift: DataFrame | None = None  # (pk..., kind)
    primary_key: list[str] = field(default_factory=list)
    rows_compared: int = 0
    segments_scanned: int = 0
    candidates_before_recheck: int = 0
    cutoff: str | None = None
    duration_seconds: float = 0.0
    error: str | None = None
    kept: list[DataFrame] = field(default_factory=list)  # what executors hold for it

    @functools.cached_property
    def drift_by_kind(self) -> dict[str, int]:
        counted = dict.fromkeys(KINDS, 0)
        if self.drift is not None:
            counted.update((r["kind"], r["count"]) for r in self.drift.groupBy("kind").count().collect())
        return counted

    @property
    def drift_total(self) -> int:
        return sum(self.drift_by_kind.values())

    @property
    def in_sync(self) -> bool:
        return self.exit_code == IN_SYNC

    @property
    def exit_code(self) -> int:
        if self.error is not None:
            return FAILED
        return DRIFT if self.drift_total else IN_SYNC

    def keys(self, limit: int | None = None) -> Iterator[tuple[tuple, str]]:
        """Keys in order with their kind; the driver holds one partition at a time, or ``limit`` keys."""
        if self.drift is None:
            return
        ordered = self.drift.orderBy(*(F.col(f"`{c}`") for c in self.primary_key))
        for *key, kind in ordered.toLocalIterator() if limit is None else ordered.limit(limit).collect():
            yield tuple(key), kind

    def summary(self) -> dict[str, Any]:
        return {name: read(self) for name, read in FIELDS.items()}

    def release(self) -> None:
        """Give up what executors hold; the drift can still be had, by computing it again."""
        for df in self.kept:
            df.unpersist()


# The fields of a report in JSON, beside ``drift_keys``.
FIELDS = {
    "comparison": lambda r: r.comparison,
    "in_sync": lambda r: r.in_sync,
    "drift_total": lambda r: r.drift_total,
    "drift_by_kind": lambda r: r.drift_by_kind,
    "rows_compared": lambda r: r.rows_compared,
    "segments_scanned": lambda r: r.segments_scanned,
    "candidates_before_recheck": lambda r: r.candidates_before_recheck,
    "cutoff": lambda r: r.cutoff,
    "duration_seconds": lambda r: round(r.duration_seconds, 3),
    "error": lambda r: r.error,
}


@functools.singledispatch
def plain(value: Any) -> Any:
    """A key part as JSON has it: what JSON lacks becomes text."""
    return str(value)


@plain.register(type(None))
@plain.register(int)
@plain.register(str)
def _(value):
    return value


@plain.register
def _(value: float):
    return value if math.isfinite(value) else repr(value)


@plain.register
def _(value: Decimal):
    text = format(value, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


@plain.register
def _(value: datetime.date):  # and times
    return value.isoformat()


@plain.register(bytes)
@plain.register(bytearray)
def _(value):
    return bytes(value).hex()


def write_json(report: Report, out) -> None:
    """One JSON object, fields in order of their names. Keys are written as they come, so drift of any size fits."""
    for i, (name, value) in enumerate(sorted({**report.summary(), "drift_keys": None}.items())):
        out.write(f"{', ' if i else '{'}{json.dumps(name)}: ")
        if name != "drift_keys":
            out.write(json.dumps(value, sort_keys=True, ensure_ascii=False))
            continue
        for j, (key, kind) in enumerate(report.keys()):
            out.write((", " if j else "[") + json.dumps({"key": [plain(v) for v in key], "kind": kind}, ensure_ascii=False))
        out.write("]" if report.drift_total else "[]")
    out.write("}")


def write_text(report: Report, out, sample: int = 20) -> None:
    """A line with the verdict, a table of kinds with some keys of the first kinds, a line on the work done."""
    if report.error is not None:
        out.write(f"{report.comparison}: FAILED ({report.error})")
        return
    total = report.drift_total
    out.write(f"{report.comparison}: {f'DRIFT, {total} keys differ' if total else 'IN SYNC'}\n")
    if total:
        shown: dict[str, list[str]] = {}
        for key, kind in report.keys(sample):
            shown.setdefault(kind, []).append("/".join(str(plain(v)) for v in key))
        for kind, n in report.drift_by_kind.items():
            own = shown.get(kind, [])
            rest = " ..." if len(own) < n else ""
            out.write(f"  {kind:<8}{n:>12}  {' '.join(own)}{rest}\n")
    work = f"{report.rows_compared} rows compared, {report.segments_scanned} segments scanned, {report.candidates_before_recheck} candidates before rechecks"
    out.write(f"  {work}, cutoff {report.cutoff or 'none'}, {report.duration_seconds:.1f} s")


WRITERS = {"text": write_text, "json": write_json}


def rendered(report: Report, form: str = "text") -> str:
    out = io.StringIO()
    WRITERS[form](report, out)
    return out.getvalue()


def print_report(report: Report, form: str = "text", stream=None) -> int:
    if form not in WRITERS:
        raise ValueError(f"unknown format {form!r}")
    out = stream or sys.stdout
    WRITERS[form](report, out)
    out.write("\n")
    return report.exit_code
