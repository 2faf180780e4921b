"""Adaptive time-bucket averages over labelled counters."""

from __future__ import annotations

import calendar
import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lenient_int
from .filters import above, mentions, time_range

ATTRIBUTES = ["object_name", "sai_type_id", "sai_stat_id"]

# The date texts understood as bounds; any other text is no bound.
_DATE_TEXT = re.compile(
    r"(\d{4})-(\d{2})-(\d{2})"
    r"(?:[ T](\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*(?:Z|([+-])(\d{2}):(\d{2}))?)?"
)
_SECOND = 1_000_000_000


def epoch_seconds(text: str) -> int | None:
    """Whole epoch seconds of a date text, UTC unless it names an offset; else None."""
    match = _DATE_TEXT.fullmatch(text.strip())
    if not match:
        return None
    sign, (year, month, day, hour, minute, second, off_hour, off_minute) = match[7], (
        int(g or 0) for g in (*match.groups()[:6], *match.groups()[7:])
    )
    in_range = 1 <= month <= 12 and 1 <= day <= 31 and hour <= 24 and minute < 60 and second < 60
    if not in_range or year == 0:
        return None
    offset = (off_hour * 3600 + off_minute * 60) * (-1 if sign == "-" else 1)
    return calendar.timegm((year, month, day, hour, minute, second)) - offset


def _given(bound: int | str | None) -> int | None:
    """A bound in nanoseconds; None when it is empty or unusable text."""
    if not isinstance(bound, str):
        return bound
    seconds = epoch_seconds(bound)
    return None if seconds is None else seconds * _SECOND


def time_bounds(
    points: DataFrame, start: int | str | None = None, end: int | str | None = None
) -> tuple[Column, Column]:
    """(t_start, t_end) in nanoseconds, as columns usable in filters and projections.

    A bound is nanoseconds, a date text, or empty for the extreme of the data;
    unusable text counts as empty. Given bounds are literals. Both extremes come
    from one scalar subquery over one column, shared by every use.
    """
    t_start, t_end = _given(start), _given(end)
    if t_start is not None and t_end is not None:
        return F.lit(t_start), F.lit(t_end)
    extremes = points.agg(
        F.struct(F.min("timestamp_ns").alias("lo"), F.max("timestamp_ns").alias("hi"))
    ).scalar()
    return (
        extremes["lo"] if t_start is None else F.lit(t_start),
        extremes["hi"] if t_end is None else F.lit(t_end),
    )


def bucket_width(t_start: Column, t_end: Column, max_points: int) -> Column:
    """Nanoseconds per bucket so that the span has about ``max_points`` buckets."""
    one = F.lit(1).cast("bigint")
    if max_points <= 0:
        return one
    return F.greatest(one, F.call_function("div", t_end - t_start, F.lit(max_points)))


def bucket_avg(
    points: DataFrame,
    max_points: int = 1000,
    start: int | str | None = None,
    end: int | str | None = None,
    objects: list[str] | None = None,
    types: list[str] | None = None,
    stats: list[str] | None = None,
    value_col: str = "value_int",
) -> DataFrame:
    """(bucket, time, obj, tid, sid, value): average per time bucket and counter.

    ``time`` is the bucket start in whole seconds. Buckets narrower than a
    second stay separate groups, so the same ``time`` may occur several times.

    Attributes depend on their text alone, so with real buckets rows are summed
    per (bucket, text) first, and texts are parsed and filtered only after that;
    the second aggregation shuffles the few partial sums. With 1 ns buckets the
    first step would not reduce anything and is left out.
    """
    # An extreme of the data filters nothing out, so only given bounds are tested.
    rows = time_range(points, _given(start), _given(end))
    width = F.lit(1).cast("bigint")
    if max_points > 0:
        width = bucket_width(*time_bounds(points, start, end), max_points)
    for wanted in (objects, types, stats):
        prefilter = mentions("dp_attrs", wanted or [])
        rows = rows if prefilter is None else rows.where(prefilter)
    bucket = (
        F.col("timestamp_ns")
        if max_points <= 0
        else F.call_function("div", F.col("timestamp_ns"), width)
    )
    rows = rows.select(
        bucket.alias("bucket"), "dp_attrs", F.col(value_col).cast("double").alias("v")
    )
    if max_points > 0:
        partial = rows.groupBy("bucket", "dp_attrs").agg(
            F.sum("v").alias("total"), F.count("v").alias("n")
        )
    else:
        partial = rows.select(
            "bucket", "dp_attrs", F.col("v").alias("total"),
            F.expr("CAST(v IS NOT NULL AS BIGINT)").alias("n"),
        )
    fields = ", ".join(f"{name} string" for name in ATTRIBUTES)
    keyed = partial.select("bucket", "total", "n", F.from_json("dp_attrs", fields).alias("a"))
    for key, wanted in zip(ATTRIBUTES, (objects, types, stats)):
        if wanted is not None:
            keyed = keyed.where(above(F.col("n") >= 0, F.col(f"a.{key}").isin(wanted)))
    grouped = (
        keyed.select(
            "bucket",
            F.col("a.object_name").alias("obj"),
            lenient_int("a.sai_type_id").alias("tid"),
            lenient_int("a.sai_stat_id").alias("sid"),
            "total",
            "n",
        )
        .groupBy("bucket", "obj", "tid", "sid")
        .agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("value"))
    )
    time = F.expr("bucket") if max_points <= 0 else F.col("bucket") * width
    return grouped.select(
        "bucket",
        F.call_function("div", time, F.lit(1_000_000_000)).alias("time"),
        "obj",
        "tid",
        "sid",
        "value",
    )
