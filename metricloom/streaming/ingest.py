"""Fan-out ingest: one micro-batch to the series changes, the table and JSON lines."""

from __future__ import annotations

import hashlib
import logging
import threading
from collections.abc import Callable

from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.flatten import flatten
from ..operators.series import fold_by_attrs, latest_by_attrs, merge_latest
from ..sources.arrival import SPLIT_COLUMNS, numbered, staged
from ..sources.commits import CommitLog
from ..sources.jsonl import write_jsonl
from ..sources.otlp import CORRUPT, accepted, rejected
from ..sources.points import batch_folder, conform
from .rate import OBSERVED, POINTS, REJECTED

log = logging.getLogger(__name__)

# Ids of a stream: batch number above, row number in the batch below. A batch may use up several.
BATCH_ID_BITS = 34
CHANGES = (
    "series_name string, attrs string, timestamp double, value double, type_code int, first_id long, last_id long"
)
#: Batches of series changes after which they are folded into one.
FOLD_AFTER = 8


def start(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    output_mode: str = "append",
    processing_time: str | None = "500 milliseconds",
    available_now: bool = False,
) -> StreamingQuery:
    """A foreachBatch query, triggered by interval or run until the input is drained."""
    writer = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=processing_time).start()


def stream_name(checkpoint: str) -> str:
    """Folder name of a stream; the letter keeps partition discovery from reading it as a number."""
    return "s" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


class CapReached(Exception):
    """A batch came after the one that reached ``max_rows``; it stays uncommitted."""


class Ingest:
    """The sinks of one ingest stream.

    Every batch is computed once, into shared storage, and written, in this
    order, to the series changes (``series``), the point table (``table``), the
    bad requests (``rejects``) and JSON lines (``jsonl``); each path is optional.
    Series, table and rejects are tables with commits: a batch is visible as a
    whole or not at all, and replaces itself when repeated. JSON lines go to a
    folder per batch; their failure is logged and does not fail the batch; any
    other does, and the batch is tried again on restart. Changes of more than
    ``fold_after`` batches are folded into one row per series.

    Points of a stream of requests are counted in the query's progress, as are
    bad requests, which give no points.

    ``flush_points`` cuts the table's batches into units of that many points and
    a rest, each in its own files (``CommitLog.units`` lists them); 0 does not.

    ``max_rows`` stops the stream after the batch that reaches it. A batch that
    comes before the stop takes effect fails with ``CapReached``, so it is not
    committed and a restart writes it; ``wait`` takes that for a normal stop.
    0 is no cap. Numbering rows needs the table to itself: one ingest at a time.
    """

    def __init__(
        self,
        checkpoint: str,
        table: str | None = None,
        jsonl: str | None = None,
        series: str | None = None,
        rejects: str | None = None,
        max_rows: int = 0,
        flush_points: int = 0,
        fold_after: int = FOLD_AFTER,
        on_batch: Callable[[DataFrame, int], None] | None = None,
    ):
        self.checkpoint, self.table, self.jsonl, self.series = checkpoint, table, jsonl, series
        self.rejects, self.flush_points, self.fold_after = rejects, flush_points, fold_after
        self.max_rows, self.on_batch = max_rows, on_batch
        self.stream_name = stream_name(checkpoint)
        self.total = 0
        self.full = threading.Event()
        self.query: StreamingQuery | None = None
        self._first_id = 0

    def run(self, requests: DataFrame, **trigger) -> StreamingQuery:
        """Start on a stream of requests, or of points when it has no ``resourceMetrics``.

        ``trigger``: ``processing_time`` (flush interval) or ``available_now``;
        the batch size is the source's option, such as ``maxFilesPerTrigger``.
        """
        points = requests
        if "resourceMetrics" in requests.columns:
            kept = [c for c in SPLIT_COLUMNS if c in requests.columns]
            points = flatten(requests, keep=kept, rejects=CORRUPT in requests.columns)
        bad = F.count("_rejected") if "_rejected" in points.columns else F.lit(0).cast("long")
        points = points.observe(OBSERVED, (F.count("*") - bad).alias(POINTS), bad.alias(REJECTED))
        if self.table and "id" not in points.columns:
            self._first_id = self._id_base(requests.sparkSession)
        self.query = start(points, self.write, self.checkpoint, **trigger)
        if self.max_rows:
            threading.Thread(target=self._stop_when_full, daemon=True).start()
        return self.query

    def _id_base(self, spark: SparkSession) -> int:
        """A multiple of the batch range above every id other streams committed."""
        top = CommitLog(spark, self.table).last_id(but=self.stream_name)
        batches = (top + (1 << BATCH_ID_BITS) - 1) >> BATCH_ID_BITS
        return batches << BATCH_ID_BITS

    def _start_id(self, spark: SparkSession, batch_id: int) -> int:
        """Where the ids of a batch start: in its own range, unless an earlier batch outgrew its own."""
        base = self._first_id + (batch_id << BATCH_ID_BITS)
        if not self.table:
            return base
        held = CommitLog(spark, self.table).commits()
        return max([base, *(c.last_id for c in held if c.stream == self.stream_name and c.batch_id < batch_id)])

    def write(self, batch: DataFrame, batch_id: int) -> None:
        if self.full.is_set():
            raise CapReached(f"{self.total} rows reached the cap of {self.max_rows}")
        with staged(batch) as kept:
            good = kept
            if "_rejected" in kept.columns:
                good = accepted(kept)
                if self.rejects:
                    self._append(self.rejects, rejected(kept), batch_id)
            if not good.isEmpty():
                if "id" not in good.columns:
                    good = numbered(good, self._start_id(batch.sparkSession, batch_id))
                self._write_sinks(conform(good), batch_id)
        if self.max_rows and self.total >= self.max_rows:
            log.info("%d rows reached the cap of %d", self.total, self.max_rows)
            self.full.set()

    def _append(self, path: str, rows: DataFrame, batch_id: int) -> CommitLog:
        commits = CommitLog(rows.sparkSession, path)
        commits.append(rows, self.stream_name, batch_id)
        return commits

    def _write_sinks(self, points: DataFrame, batch_id: int) -> None:
        spark = points.sparkSession
        if self.table:
            # The files are written first and read by the other sinks; the commit shows them.
            table = CommitLog(spark, self.table)
            unit = None
            if self.flush_points:
                least = points.agg(F.min("id").alias("least")).scalar()
                unit = F.floor((F.col("id") - least) / self.flush_points)
            files = table.write(points, self.stream_name, batch_id, unit)
            rows = sum(f.rows for f in files)
            points = table.read(points.schema, files)
        else:
            rows = points.count()
        if self.series:
            changes = latest_by_attrs(points)
            commits = self._append(self.series, changes, batch_id)
            commits.fold(fold_by_attrs, changes.schema, self.fold_after)
        if self.table:
            table.commit(files, self.stream_name, batch_id)
        if self.on_batch:
            self.on_batch(points, batch_id)
        if self.jsonl:
            try:
                folder = batch_folder(self.jsonl, self.stream_name, batch_id)
                write_jsonl(points, folder, mode="overwrite")
            except Exception:
                log.exception("JSON lines of batch %d not written", batch_id)
        self.total += rows

    def wait(self, timeout: int | None = None) -> bool | None:
        """``awaitTermination`` of the query, for which reaching the cap is no failure."""
        try:
            return self.query.awaitTermination(timeout)
        except StreamingQueryException as error:
            if not self.full.is_set() or CapReached.__name__ not in str(error):
                raise
            return True

    def _stop_when_full(self) -> None:
        while self.query is not None and self.query.isActive:
            if self.full.wait(0.2):
                self.query.stop()
                return


def run_ingest(requests: DataFrame, checkpoint: str, **options) -> StreamingQuery:
    """Start an ``Ingest``; options of its constructor and of ``run`` may be mixed."""
    trigger = {k: options.pop(k) for k in ("processing_time", "available_now") if k in options}
    return Ingest(checkpoint, **options).run(requests, **trigger)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Latest sample per series from the changes an ingest wrote."""
    return merge_latest(CommitLog(spark, path).read(CHANGES))
