"""Data points as time-series samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import parse_labels

SERIES = ["series_name", "labels"]

_EXPANDED = """
CASE WHEN metric_type = 'histogram' THEN array(
       named_struct('series_name', concat(metric_name, '_sum'), 'value', hist_sum),
       named_struct('series_name', concat(metric_name, '_count'),
                    'value', CAST(hist_count AS DOUBLE)))
     ELSE array(named_struct(
       'series_name', metric_name,
       'value', coalesce(value_double, CAST(value_int AS DOUBLE), 0.0D)))
END
"""


def raw_samples(points: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Samples that still carry the attribute text instead of the label list.

    Parsing labels is the expensive part and depends on the text alone, so the
    series operators aggregate by text first and parse each distinct text once.
    A missing text and an empty one both mean "no labels".
    """
    carried = list(keep or [])
    return (
        points.select(
            "id",
            "metric_type",
            "timestamp_ns",
            F.expr("coalesce(dp_attrs, '')").alias("attrs"),
            *carried,
            F.explode(F.expr(_EXPANDED)).alias("s"),
        )
        .where("s.value IS NOT NULL")
        .select(
            "id",
            "s.series_name",
            "attrs",
            "timestamp_ns",
            F.expr("CAST(timestamp_ns AS DOUBLE) / 1e9D").alias("timestamp"),
            "s.value",
            "metric_type",
            *carried,
        )
    )


def to_samples(points: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(id, series_name, labels, timestamp, value, metric_type, *keep), one row per sample.

    A histogram gives ``<name>_sum`` and ``<name>_count`` where present; every
    other point gives its double, else its integer, else 0. Narrow: no shuffle.
    """
    carried = list(keep or [])
    return raw_samples(points, carried).select(
        "id",
        "series_name",
        parse_labels("attrs").alias("labels"),
        "timestamp",
        "value",
        "metric_type",
        *carried,
    )
