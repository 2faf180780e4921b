"""Ordered extracts of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .filters import metric, time_range

_BLOCK_BITS = 20
#: Up to so many rows Spark's own top-k is used, which brings them to one task; beyond, blocks of ids.
TOP_K = 100_000


def _time_order(points: DataFrame) -> list[str]:
    """Time, then arrival: a total order, and one that splits an instant with many rows."""
    return [c for c in ("timestamp_ns", "id") if c in points.columns]


def time_series(
    points: DataFrame, name: str, t0: int | None = None, t1: int | None = None
) -> DataFrame:
    """(time in whole seconds, value) of one metric's double values, in time order."""
    rows = time_range(metric(points, name), t0, t1)
    return rows.orderBy(*_time_order(rows)).selectExpr(
        "timestamp_ns div 1000000000 AS time", "value_double AS value"
    )


def time_series_float(points: DataFrame, name: str) -> DataFrame:
    """(time in seconds with fraction, value) of one metric's integer values, in time order."""
    rows = metric(points, name)
    return rows.orderBy(*_time_order(rows)).selectExpr(
        "CAST(timestamp_ns AS DOUBLE) / 1e9D AS time", "value_int AS value"
    )


def histogram_rows(
    points: DataFrame, name: str, t0: int | None = None, t1: int | None = None
) -> DataFrame:
    """(time, hist_bounds, hist_counts) of one histogram metric, in time order."""
    rows = time_range(metric(points, name, "histogram"), t0, t1)
    return rows.orderBy(*_time_order(rows)).selectExpr(
        "timestamp_ns div 1000000000 AS time", "hist_bounds", "hist_counts"
    )


def histogram_arrays(rows: DataFrame) -> DataFrame:
    """Typed bucket arrays from the JSON text columns."""
    return rows.select(
        "*",
        F.from_json("hist_bounds", "array<double>").alias("bounds"),
        F.from_json("hist_counts", "array<decimal(20,0)>").alias("counts"),
    )


def head(points: DataFrame, n: int = 10_000) -> DataFrame:
    """The first ``n`` rows by arrival, in that order."""
    if n <= TOP_K:
        return points.orderBy("id").limit(n)
    return _first_arrivals(points, n).orderBy("id")


def tail(points: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows by arrival, latest first."""
    if n <= TOP_K:
        return points.orderBy(F.desc("id")).limit(n)
    return _first_arrivals(points, n, latest=True).orderBy(F.desc("id"))


def first_point(points: DataFrame, name: str) -> DataFrame:
    """The earliest row of a metric."""
    rows = metric(points, name)
    return rows.orderBy(*_time_order(rows)).limit(1)


def cap_rows(points: DataFrame, max_rows: int, batch_size: int = 1) -> DataFrame:
    """The rows a run stopped at ``max_rows`` would have written, in no order.

    The total is checked after each batch of ``batch_size`` rows, so the result
    overshoots to the end of that batch. 0 means no cap.
    """
    if max_rows <= 0:
        return points
    n = -(-max_rows // batch_size) * batch_size
    return points.orderBy("id").limit(n) if n <= TOP_K else _first_arrivals(points, n)


def _first_arrivals(points: DataFrame, n: int, latest: bool = False) -> DataFrame:
    """Exactly the ``n`` least ids (``latest``: greatest), without sorting the table or one big task.

    Ids are counted in blocks; blocks wholly before the n-th row are kept by a
    plain comparison that reaches the scan, and only the block that holds the
    n-th row is ranked. Ids are unique, so a block never exceeds its width.
    """
    way = F.desc if latest else F.asc
    block = F.shiftright("id", _BLOCK_BITS)
    counts = points.groupBy(block.alias("block")).agg(F.count("*").alias("rows"))
    # One row per million ids, a pre-aggregated summary.
    running = counts.select("block", "rows", F.sum("rows").over(Window.orderBy(way("block"))).alias("upto"))
    # The first block, in order, by whose end there are n rows.
    least, by = (F.max, F.max_by) if latest else (F.min, F.min_by)
    edge = running.where(F.col("upto") >= n).agg(
        least("block").alias("block"), (F.lit(n) - by(F.col("upto") - F.col("rows"), "block")).alias("remaining")
    )
    # Shift and default stay inside the subquery: only a bare value is pushed to the scan.
    bounds = edge.select(
        F.coalesce(F.shiftleft("block", _BLOCK_BITS), F.lit(-(2**63) if latest else 2**63 - 1)).alias("low"),
        F.coalesce(F.shiftleft(F.col("block") + 1, _BLOCK_BITS), F.lit(-(2**63) if latest else 2**63 - 1)).alias("high"),
    )
    low, high = bounds.select("low").scalar(), bounds.select("high").scalar()
    whole = points.where(F.col("id") >= high if latest else F.col("id") < low)
    partial = (
        points.where((F.col("id") >= low) & (F.col("id") < high))
        .withColumn("_rank", F.row_number().over(Window.orderBy(way("id"))))
        .where(F.col("_rank") <= edge.select("remaining").scalar())
        .drop("_rank")
    )
    return whole.union(partial)
