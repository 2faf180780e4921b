"""Human-readable series names from small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def label_series(df: DataFrame, types: DataFrame, stats: DataFrame) -> DataFrame:
    """Add ``series``: ``<object>_<type name>_<stat name>``.

    Left joins keep rows without a name; they read ``T<id>`` and ``stat<id>``.
    No broadcast is forced: the optimizer broadcasts a dimension whose size it
    knows to be under its threshold and shuffles a larger one.
    """
    named = df.join(types.withColumnRenamed("type_id", "tid"), "tid", "left").join(
        stats.withColumnsRenamed({"type_id": "tid", "stat_id": "sid"}), ["tid", "sid"], "left"
    )
    series = F.concat(
        F.col("obj"),
        F.lit("_"),
        F.coalesce("type_name", F.concat(F.lit("T"), F.col("tid").cast("string"))),
        F.lit("_"),
        F.coalesce("stat_name", F.concat(F.lit("stat"), F.col("sid").cast("string"))),
    )
    return named.select(*df.columns, series.alias("series"))


def dashboard(averages: DataFrame, types: DataFrame, stats: DataFrame) -> DataFrame:
    """(time, value, series) of a bucket average, ordered for charting."""
    return (
        label_series(averages, types, stats)
        .orderBy("time", "series", "bucket")
        .select("time", "value", "series")
    )


def wide(long: DataFrame, series: list[str]) -> DataFrame:
    """One column per listed series, one row per time.

    Sub-second buckets sharing a second are averaged into its cell.
    """
    return long.groupBy("time").pivot("series", series).agg(F.avg("value")).orderBy("time")
