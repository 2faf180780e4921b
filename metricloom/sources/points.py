"""The point table: append, scan and the layout for analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import METRIC_SCHEMA, TABLE_NAME
from .arrival import numbered, staged
from .commits import CommitLog, first_files


def read_points(
    spark: SparkSession, path: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """The table's committed rows with its fixed schema; nothing is inferred from files.

    With ``first`` (``last``) only the files are read that can hold that many rows
    of least (greatest) id, chosen by the ids that the commits tell of; ``head``
    and ``tail`` of the result are those of the table. A folder without commits,
    such as the analysis layout, is read whole.
    """
    log = CommitLog(spark, path)
    if not log.exists():
        return spark.read.schema(METRIC_SCHEMA).parquet(path).select(*METRIC_SCHEMA.fieldNames())
    files = None
    if first is not None or last is not None:
        files = first_files(log.data_files(), first if first is not None else last, latest=first is None)
    return log.read(METRIC_SCHEMA, files).select(*METRIC_SCHEMA.fieldNames())


def max_id(spark: SparkSession, path: str) -> int:
    """Highest arrival id in the table, 0 when it is empty or does not exist; told by its commits."""
    return CommitLog(spark, path).last_id()


def conform(points: DataFrame) -> DataFrame:
    """Exactly the table's columns and types; absent columns are NULL."""
    return points.select(
        *[
            (F.col(f.name) if f.name in points.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in METRIC_SCHEMA.fields
        ]
    )


def batch_folder(path: str, stream: str, batch_id: int) -> str:
    """Where a batch of a sink without commits lives."""
    return f"{path}/stream={stream}/batch_id={batch_id}"


def append_points(points: DataFrame, path: str) -> None:
    """Append a batch, which becomes visible as a whole. Rows without ``id`` are numbered
    after the highest id that the commits tell of. One writer at a time.
    """
    log = CommitLog(points.sparkSession, path)
    if "id" in points.columns:
        log.append(conform(points), "append")
        return
    with staged(points) as kept:
        log.append(conform(numbered(kept, log.last_id())), "append")


#: Rows of a file of the analysis layout at most.
ROWS_PER_FILE = 4_000_000


def write_analysis_layout(
    points: DataFrame, path: str, files: int | None = None, rows_per_file: int = ROWS_PER_FILE
) -> None:
    """Rewrite the table for queries by type, name and time.

    Folders by type, files split by (type, name, time) ranges and sorted inside,
    so a filter on any of them skips folders, files and row groups. ``id`` ends
    the range key: a name or instant holding most rows is still split evenly.
    A range of more than ``rows_per_file`` rows is cut into several files in
    order, so the span of a file does not grow with the table. Bloom filters on
    the name skip row groups whose range merely spans it.
    """
    keys = ["metric_type", "metric_name", "timestamp_ns", "id"]
    ranged = (
        conform(points).repartitionByRange(files, *keys)
        if files
        else conform(points).repartitionByRange(*keys)
    )
    (
        ranged.sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .option("parquet.bloom.filter.enabled#metric_name", "true")
        .partitionBy("metric_type")
        .parquet(path)
    )


def register_points(spark: SparkSession, path: str, name: str = TABLE_NAME) -> DataFrame:
    """Make the table visible to ad-hoc SQL under ``name``."""
    points = read_points(spark, path)
    points.createOrReplaceTempView(name)
    return points
