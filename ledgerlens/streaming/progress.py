"""Totals over a stream's progress: rows read, and rows that came later than the watermark allows."""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


@dataclass
class Total:
    """Of one run of a query; complete once ``ended`` is set."""

    received: int = 0
    late: int = 0
    batches: int = 0
    ended: threading.Event = field(default_factory=threading.Event)


class Totals(StreamingQueryListener):
    """Adds up every progress report, of which Spark itself keeps only the last hundred."""

    def __init__(self) -> None:
        self._runs: dict[str, Total] = defaultdict(Total)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run = self._runs[str(event.progress.runId)]
        run.batches += 1
        run.received += max(0, event.progress.numInputRows)
        run.late += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        self._runs[str(event.runId)].ended.set()

    def of(self, query: StreamingQuery, wait_seconds: float = 60) -> Total:
        """The totals of a query that has ended; reports come in shortly after."""
        run = self._runs[str(query.runId)]
        if not run.ended.wait(wait_seconds):
            raise TimeoutError(f"no end of query {query.runId} was reported in {wait_seconds} s")
        return run


@contextmanager
def totals(spark: SparkSession) -> Iterator[Totals]:
    """A listener for the queries started inside."""
    listener = Totals()
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def as_row(spark: SparkSession, runs: list[Total]) -> DataFrame:
    """One row: rows received and rows dropped as late over several runs."""
    return spark.createDataFrame([(sum(r.received for r in runs), sum(r.late for r in runs))], "received bigint, late bigint")
