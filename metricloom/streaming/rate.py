"""Ingest rate, as a windowed count and as a live log."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)

#: Name and members of what an ingest observes of each batch.
OBSERVED, POINTS, REJECTED = "metricloom_ingest", "points", "rejected"


def ingest_rate(
    df: DataFrame, ts_col: str, interval_seconds: int = 5, late: str | None = None
) -> DataFrame:
    """(window_start, rows, rows_per_second) per tumbling interval that has rows.

    ``late`` is the watermark delay of a stream: windows older than it are
    final and leave the state. Batch input needs none.
    """
    if late is not None:
        df = df.withWatermark(ts_col, late)
    counts = df.groupBy(F.window(ts_col, f"{interval_seconds} seconds").alias("w")).agg(
        F.count("*").alias("rows")
    )
    return counts.select(
        F.col("w.start").alias("window_start"),
        "rows",
        (F.col("rows") / float(interval_seconds)).alias("rows_per_second"),
    )


class IngestRateLog(StreamingQueryListener):
    """Logs new points and points/s about every ``interval`` seconds.

    An ingest tells how many points its requests held, and how many requests it
    rejected; of another query its input rows count. Silent before the first
    data and while nothing arrives. Register with ``spark.streams.addListener``.
    """

    def __init__(self, interval: float = 5.0, clock=time.monotonic):
        self.interval, self.clock = interval, clock
        self.total = self.reported = self.rejected = 0
        self.since: float | None = None
        self.reports: list[tuple[int, float]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress.observedMetrics.get(OBSERVED)
        if told is None:
            self.add(event.progress.numInputRows)
        else:
            self.rejected += told[REJECTED] or 0
            self.add(told[POINTS] or 0)

    def add(self, rows: int) -> None:
        now = self.clock()
        if self.since is None:
            if rows == 0:
                return
            self.since = now
        self.total += rows
        elapsed, new = now - self.since, self.total - self.reported
        if elapsed < self.interval or new == 0:
            return
        self.reports.append((new, new / elapsed))
        log.info(
            "rate %.0f/s over %.1f s: %d points since the last report, %d in all", new / elapsed, elapsed, new, self.total
        )
        self.reported, self.since = self.total, now
