"""Progress of streams as rows: what a display polls, told by Spark's own listener."""

from __future__ import annotations

import threading
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: Batches that a listener remembers; totals go on counting.
REMEMBERED = 1000


class Progress(StreamingQueryListener):
    """Batches and rows of one stream, by its name or id, as they are reported; `finished` is set when it ends."""

    def __init__(self, name: str):
        self.name, self._id = name, None
        self.batches, self.rows = 0, 0
        self.recent: deque[tuple[int, int]] = deque(maxlen=REMEMBERED)
        self.failed: str | None = None
        self.finished = threading.Event()

    def onQueryStarted(self, event):
        if event.name == self.name:
            self._id = event.id

    def onQueryProgress(self, event):
        p = event.progress
        if p.name == self.name and p.numInputRows:
            self.batches += 1
            self.rows += p.numInputRows
            self.recent.append((p.batchId, p.numInputRows))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.id == self._id:
            self.failed = event.exception
            self.finished.set()


def watched(writer, spark: SparkSession, name: str, timeout: float = 600.0) -> Progress:
    """Runs a stream writer under a name to its end and returns its progress."""
    listener = Progress(name)
    spark.streams.addListener(listener)
    try:
        query = writer.queryName(name).start()
        query.awaitTermination()
        listener.finished.wait(timeout)
    finally:
        spark.streams.removeListener(listener)
    return listener


def as_rows(spark: SparkSession, progress: Progress) -> DataFrame:
    return spark.createDataFrame([(progress.batches, progress.rows, progress.finished.is_set() and progress.failed is None)], "batches long, rows long, finished boolean")
