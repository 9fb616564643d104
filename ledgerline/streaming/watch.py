"""Beyond batch runs: compare again whenever a stream of changes brings a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.compare import Loader, compare
from ..plans.config import Comparison
from ..plans.report import Report


def watch(changes: DataFrame, source: Loader, target: Loader, cmp: Comparison, tell: Callable[[int, Report], None], **trigger) -> StreamingQuery:
    """Each micro-batch of ``changes`` that has rows starts a comparison; ``tell`` gets its number and report."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            tell(number, compare(source, target, cmp))

    return changes.writeStream.foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()
