"""Lag is not drift: cutoffs and rechecks."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from .diff import diff
from .predicates import with_keys


def cutoff(watermark: str | None, grace_seconds: float, now: datetime.datetime | None = None) -> datetime.datetime | None:
    """Taken once a run: now less the grace window; None without a watermark."""
    if not watermark:
        return None
    return (now or datetime.datetime.now(datetime.timezone.utc)) - datetime.timedelta(seconds=grace_seconds)


def recheck(
    candidates: DataFrame, pk: list[str], load: Callable[[], tuple[DataFrame, DataFrame]], delay: float, rounds: int,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Candidates that still differ after each of ``rounds`` looks at fresh data, with their kind then.

    ``load`` reads both sides anew, hashed and without a cutoff: a DataFrame kept from before
    would show the old files.
    """
    current = candidates
    for k in range(rounds):
        if current.isEmpty():
            break
        if delay > 0:
            sleep(delay)
        source, target = load()
        last, current = current, diff(with_keys(source, current, pk), with_keys(target, current, pk), pk).persist()
        current.count()  # kept before the last look goes
        if k:
            last.unpersist()
    return current
