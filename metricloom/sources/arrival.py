"""Arrival numbers: dense ids in request order, without a global sort."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window, functions as F

from .commits import Files
from .scratch import scratch_dir, written

# Columns read_otlp adds so that arrival order survives the scheduling of files.
SPLIT_COLUMNS = ["_file_time", "_file", "_block"]
# Positions of a split that are ranked together where rows were left out.
RANKED = 1 << 16


@contextmanager
def staged(points: DataFrame) -> Iterator[DataFrame]:
    """``points`` computed once, into a scratch table that is deleted at the end.

    The rows keep their position (``_seq``) and, without SPLIT_COLUMNS, their
    partition (``_part``). A table on shared storage outlives executors, so all
    later passes agree on both.
    """
    if not any(c in points.columns for c in SPLIT_COLUMNS):
        points = points.withColumn("_part", F.spark_partition_id())
    path = scratch_dir(points.sparkSession)
    points.withColumn("_seq", F.monotonically_increasing_id()).write.parquet(path)
    try:
        yield points.sparkSession.read.parquet(path)
    finally:
        Files(points.sparkSession).delete(path)


def numbered(kept: DataFrame, base: int = 0) -> DataFrame:
    """``staged`` rows with ``id`` base+1, base+2, ... in arrival order.

    Arrival order is file time, file name, position in the file when the rows
    carry SPLIT_COLUMNS, else the order of the partitions. Rows are counted per
    input split; each split starts where those before it end. The starts, one
    row per split, are a written table whose size Spark knows: it broadcasts
    them under its threshold and shuffles beyond. Where rows were left out since
    they were staged, those that remain are ranked per ``RANKED`` positions.
    """
    key = [c for c in SPLIT_COLUMNS if c in kept.columns] or ["_part"]
    span = F.max("_seq") - F.min("_seq") + 1
    starts = _starts(kept, key, base, (span > F.count("*")).alias("_gaps"))
    if not starts.where("_gaps").isEmpty():
        kept = kept.withColumn("_run", F.expr(f"_seq div {RANKED}"))
        key = [*key, "_run"]
        kept = kept.withColumn("_seq", F.row_number().over(Window.partitionBy(*key).orderBy("_seq")).cast("long"))
        starts = _starts(kept, key, base, F.lit(False).alias("_gaps"))
    starts = starts.drop("_gaps")
    return kept.join(starts, key).withColumn("id", F.col("_seq") + F.col("_shift")).drop("_seq", "_shift", *key)


def _starts(kept: DataFrame, key: list[str], base: int, gaps: Column) -> DataFrame:
    """``(*key, _shift, _gaps)``: what makes positions ids, if the rows of a key have consecutive ones."""
    counts = kept.groupBy(*key).agg(F.count("*").alias("n"), F.min("_seq").alias("first"), gaps)
    before = F.sum("n").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1))
    shift = F.coalesce(before, F.lit(0)) + base + 1 - F.col("first")
    return written(counts.select(*key, shift.alias("_shift"), "_gaps"))


@contextmanager
def arrival_ids(points: DataFrame, base: int = 0) -> Iterator[tuple[DataFrame, int]]:
    """``points`` with ``id`` as ``numbered`` gives them, and their number. For use inside ``with``."""
    with staged(points) as kept:
        yield numbered(kept, base), kept.count()


def in_order(points: DataFrame, *order: str) -> DataFrame:
    """Range-partitioned by columns that tell arrival (an offset, a receive time).

    The partitions are then in arrival order, as ``numbered`` expects. The
    columns should identify a row, so that a repeated computation agrees.
    """
    return points.repartitionByRange(*order).sortWithinPartitions(*order)
