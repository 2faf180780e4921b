"""Row filters on points."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import attr


def mentions(text: str, values: list[str]) -> Column | None:
    """A cheap test that every attribute text holding one of ``values`` passes.

    Without a backslash in the text a JSON string appears verbatim in it, so
    ``contains`` is a necessary condition; it needs no JSON parsing and works on
    dictionary pages. None when a value may be spelled differently in the text:
    numbers, nested JSON, quotes and control characters.
    """
    respelled = re.compile(r"""\s*[-+0-9.\[{]|$|.*["\x00-\x1f]""", re.DOTALL)
    if not values or any(respelled.match(v) for v in values):
        return None
    condition = F.col(text).contains("\\")
    for value in values:
        condition = condition | F.col(text).contains(value)
    return condition


def above(always: Column, condition: Column) -> Column:
    """``condition``, tied to an aggregation by a test of its output that always holds.

    A condition on a grouping column alone would be pushed below the
    aggregation, and the JSON parsing in it with it, onto every row. The
    optimizer must not see that ``always`` holds: test a count for being
    positive, not for being there.
    """
    return F.when(always, condition)


def time_range(
    points: DataFrame, t0: int | Column | None = None, t1: int | Column | None = None
) -> DataFrame:
    """Inclusive nanosecond range; a literal or scalar-subquery bound reaches the scan."""
    if t0 is not None:
        points = points.where(F.col("timestamp_ns") >= t0)
    if t1 is not None:
        points = points.where(F.col("timestamp_ns") <= t1)
    return points


def attr_in(points: DataFrame, key: str, values: list[str] | None) -> DataFrame:
    """Attribute ``key`` is one of ``values``; None means every row."""
    if values is None:
        return points
    prefilter = mentions("dp_attrs", values)
    if prefilter is not None:
        points = points.where(prefilter)
    return points.where(attr("dp_attrs", key).isin(values))


def metric(points: DataFrame, name: str, metric_type: str | None = None) -> DataFrame:
    """Exact metric name, and type when given."""
    points = points.where(F.col("metric_name") == name)
    return points if metric_type is None else points.where(F.col("metric_type") == metric_type)


def attr_like(points: DataFrame, pattern: str) -> DataFrame:
    """``LIKE`` on the attribute text, ignoring case; a backslash is an ordinary character."""
    return points.where(F.col("dp_attrs").ilike(pattern.replace("\\", "\\\\")))
