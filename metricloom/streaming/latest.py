"""Latest sample per series, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.samples import SERIES
from ..operators.series import latest_per_series
from ..sources.commits import CommitLog
from .ingest import FOLD_AFTER, start, stream_name

_CHANGES = (
    "stream string, batch_id long, series_name string, labels array<struct<k:string,v:string>>,"
    " timestamp double, value double, metric_type string, first_id long, last_id long"
)
_COLUMNS = ["timestamp", "value", "metric_type", "first_id", "last_id"]


def run_latest(
    points: DataFrame, path: str, checkpoint: str, fold_after: int = FOLD_AFTER, **trigger
) -> StreamingQuery:
    """Keep series state in the stream and commit each batch's changed series.

    No watermark: the state holds one row of primitives per series and late
    arrivals must still count. Batches carry a name derived from the checkpoint,
    so a repeated batch changes nothing and streams can share ``path``. After
    ``fold_after`` batches the changes are folded into a snapshot, sorted by
    series, so what a reader opens is bounded by the series and that number.
    """
    name = stream_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        commits = CommitLog(batch.sparkSession, path)
        own = batch.select(
            F.lit(name).alias("stream"), F.lit(batch_id).cast("long").alias("batch_id"), *SERIES, *_COLUMNS
        )
        commits.append(own, name, batch_id)
        commits.fold(lambda changes: _newest(changes).sortWithinPartitions(*SERIES), own.schema, fold_after)

    return start(latest_per_series(points), write, checkpoint, "update", **trigger)


def _newest(changes: DataFrame) -> DataFrame:
    """Per stream and series the most recent change."""
    newest = [F.max_by(c, "batch_id").alias(c) for c in _COLUMNS]
    return changes.groupBy("stream", *SERIES).agg(F.max("batch_id").alias("batch_id"), *newest).select(changes.columns)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The state as of the last batch: per stream and series its most recent change.

    Of streams that share a series, the one with the last arrival gives its
    value and the one with the first arrival its type.
    """
    return (
        _newest(CommitLog(spark, path).read(_CHANGES))
        .groupBy(*SERIES)
        .agg(
            F.max_by("timestamp", "last_id").alias("timestamp"),
            F.max_by("value", "last_id").alias("value"),
            F.min_by("metric_type", "first_id").alias("metric_type"),
            F.min("first_id").alias("first_id"),
            F.max("last_id").alias("last_id"),
        )
    )
