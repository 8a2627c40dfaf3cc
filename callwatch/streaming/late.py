"""Rows that came later than the watermark allows: dropped, but counted."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class LateRows(StreamingQueryListener):
    """Counts, by a query's name or else its id, the rows that stateful operators
    drop because the watermark has passed them. An aggregate counts groups of a
    batch that are late, as they reach it after partial aggregation; a processor
    or a de-duplication counts rows."""

    def __init__(self) -> None:
        self.counts: Counter[str] = Counter()
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        late = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        if late:
            with self._lock:
                self.counts[event.progress.name or str(event.progress.id)] += late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watch_late_rows(spark: SparkSession) -> LateRows:
    """A listener that counts from now on; ``spark.streams.removeListener`` ends it."""
    listener = LateRows()
    spark.streams.addListener(listener)
    return listener


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has dropped in the batches it still remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
