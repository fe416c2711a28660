"""Counters of running streams."""

from __future__ import annotations

from threading import Lock

from pyspark.sql.streaming.listener import StreamingQueryListener


class RunCounters(StreamingQueryListener):
    """Rows, batches, late rows and the last rate of all streams of a session.

    Add with spark.streams.addListener(counters).
    """

    def __init__(self) -> None:
        self._lock = Lock()
        self.rows = self.batches = self.late_rows = 0
        self.rows_per_second = 0.0

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            self.rows += p.numInputRows
            self.batches += p.numInputRows > 0
            self.late_rows += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
            self.rows_per_second = p.processedRowsPerSecond or self.rows_per_second

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
