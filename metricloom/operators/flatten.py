"""Nested export requests to one row per data point."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import attrs_to_json
from ..functions.numbers import as_i32_sql, as_i64_sql, json_f64_sql, unsigned_text_sql
from ..schema import POINT_COLUMNS
from ..sources.otlp import CORRUPT, request_error_sql

# Data kind in the request -> metric_type of its points.
_KINDS = {
    "gauge": "gauge",
    "sum": "sum",
    "histogram": "histogram",
    "exponentialHistogram": "exp_histogram",
    "summary": "summary",
}

# Enum names the JSON encoding may use instead of numbers.
_TEMPORALITY = (
    "CASE {c} WHEN 'AGGREGATION_TEMPORALITY_UNSPECIFIED' THEN 0"
    " WHEN 'AGGREGATION_TEMPORALITY_DELTA' THEN 1"
    " WHEN 'AGGREGATION_TEMPORALITY_CUMULATIVE' THEN 2"
    " ELSE coalesce(try_cast({c} AS INT), 0) END"
)


# An unreadable count keeps its place, so those after it do not shift.
_COUNT = f"coalesce({unsigned_text_sql('bc')}, 'null')"


def _json_array(items: str, var: str, element: str) -> str:
    return (
        f"concat('[', array_join(transform(coalesce({items}, array()),"
        f" {var} -> {element}), ','), ']')"
    )


def _buckets(side: str) -> str:
    """Exponential buckets as an object, or null when the side is absent."""
    counts = _json_array(f"p.{side}.bucketCounts", "bc", _COUNT)
    return (
        f"CASE WHEN p.{side} IS NULL THEN 'null' ELSE concat('{{\"bucket_counts\":', {counts},"
        f" ',\"offset\":', CAST(coalesce(p.{side}.offset, 0) AS STRING), '}}') END"
    )


def _exponential_extra() -> str:
    zero_count = f"coalesce({unsigned_text_sql('p.zeroCount')}, '0')"
    threshold = json_f64_sql("coalesce(p.zeroThreshold, 0.0D)")
    return (
        f"concat('{{\"negative\":', {_buckets('negative')}, ',\"positive\":',"
        f" {_buckets('positive')}, ',\"scale\":', CAST(coalesce(p.scale, 0) AS STRING),"
        f" ',\"zero_count\":', {zero_count}, ',\"zero_threshold\":', {threshold}, '}}')"
    )


def _summary_extra() -> str:
    quantile = json_f64_sql("coalesce(qv.quantile, 0.0D)")
    value = json_f64_sql("coalesce(qv.value, 0.0D)")
    return _json_array(
        "p.quantileValues",
        "qv",
        f"concat('{{\"quantile\":', {quantile}, ',\"value\":', {value}, '}}')",
    )


def _point_columns(kinded: str) -> dict[str, str]:
    """Output column -> expression over (point ``p``, kind ``k`` and metric context)."""
    number = f"{kinded} IN ('gauge', 'sum')"
    counted = f"{kinded} IN ('histogram', 'exp_histogram', 'summary')"
    ranged = f"{kinded} IN ('histogram', 'exp_histogram')"
    start = as_i64_sql("p.startTimeUnixNano")
    return {
        "timestamp_ns": f"coalesce({as_i64_sql('p.timeUnixNano')}, 0L)",
        "value_double": f"CASE WHEN {number} THEN p.asDouble END",
        "value_int": (
            f"CASE WHEN {number} AND p.asDouble IS NULL THEN try_cast(p.asInt AS BIGINT) END"
        ),
        "hist_count": f"CASE WHEN {counted} THEN coalesce({as_i64_sql('p.count')}, 0L) END",
        "hist_sum": (
            f"CASE WHEN {kinded} = 'summary' THEN coalesce(p.sum, 0.0D)"
            f" WHEN {ranged} THEN p.sum END"
        ),
        "hist_min": f"CASE WHEN {ranged} THEN p.min END",
        "hist_max": f"CASE WHEN {ranged} THEN p.max END",
        "hist_bounds": (
            f"CASE WHEN {kinded} = 'histogram' THEN"
            f" {_json_array('p.explicitBounds', 'eb', json_f64_sql('eb'))} END"
        ),
        "hist_counts": (
            f"CASE WHEN {kinded} = 'histogram' THEN"
            f" {_json_array('p.bucketCounts', 'bc', _COUNT)} END"
        ),
        "extra_data": (
            f"CASE WHEN {kinded} = 'exp_histogram' THEN {_exponential_extra()}"
            f" WHEN {kinded} = 'summary' THEN {_summary_extra()} END"
        ),
        "start_timestamp_ns": f"nullif({start}, 0L)",
        "flags": f"coalesce({as_i32_sql('p.flags')}, 0)",
    }


def flatten(requests: DataFrame, keep: list[str] | None = None, rejects: bool = False) -> DataFrame:
    """One row per data point of every request, in request order.

    ``requests`` holds a ``resourceMetrics`` column of OTLP_SCHEMA. ``keep``
    names further input columns to carry along (file metadata, an arrival time).
    The plan is narrow: four explodes and projections, no shuffle.

    With ``rejects``, a request that ``sources.otlp`` finds bad (it is then
    expected to have a ``_corrupt`` column) gives no points but one row, whose
    ``_rejected`` holds its line and the reason; ``accepted`` and ``rejected``
    take the result apart. Without, an unreadable number reads as absent.

    Resource text is rendered before its points are unnested, so it is built
    once per resource rather than once per point.
    """
    carried = list(keep or [])
    explode = F.explode
    if rejects:
        requests = requests.withColumn("_reason", F.expr(request_error_sql())).select(
            *carried,
            F.expr("CASE WHEN _reason IS NULL THEN resourceMetrics END").alias("resourceMetrics"),
            F.expr(
                f"CASE WHEN _reason IS NOT NULL THEN named_struct('line', coalesce({CORRUPT},"
                " to_json(named_struct('resourceMetrics', resourceMetrics))), 'reason', _reason) END"
            ).alias("_rejected"),
        )
        carried.append("_rejected")
        # A rejected request has nothing to unnest and keeps its one row through all levels.
        explode = F.explode_outer
    resources = requests.select(*carried, explode("resourceMetrics").alias("rm"))
    scopes = resources.select(
        *carried,
        attrs_to_json("rm.resource.attributes").alias("resource_attrs"),
        explode("rm.scopeMetrics").alias("sm"),
    )
    metrics = scopes.select(
        *carried,
        "resource_attrs",
        F.expr("CASE WHEN sm.scope IS NOT NULL THEN coalesce(sm.scope.name, '') END").alias(
            "scope_name"
        ),
        F.expr("nullif(sm.scope.version, '')").alias("scope_version"),
        explode("sm.metrics").alias("m"),
    )
    kind = " ".join(f"WHEN m.{field} IS NOT NULL THEN '{tag}'" for field, tag in _KINDS.items())
    data_points = " ".join(
        f"WHEN m.{field} IS NOT NULL THEN m.{field}.dataPoints" for field in _KINDS
    )
    temporality = " ".join(
        f"WHEN m.{field} IS NOT NULL THEN "
        + _TEMPORALITY.format(c=f"m.{field}.aggregationTemporality")
        for field in ("sum", "histogram", "exponentialHistogram")
    )
    points = metrics.select(
        *carried,
        "resource_attrs",
        "scope_name",
        "scope_version",
        F.expr("coalesce(m.name, '')").alias("metric_name"),
        F.expr(f"CASE {kind} END").alias("metric_type"),
        F.expr("CASE WHEN m.sum IS NOT NULL THEN coalesce(m.sum.isMonotonic, false) END").alias(
            "is_monotonic"
        ),
        F.expr(f"CASE {temporality} END").cast("int").alias("aggregation_temporality"),
        explode(F.expr(f"CASE {data_points} END")).alias("p"),
    )
    if rejects:
        points = points.where("p IS NOT NULL OR _rejected IS NOT NULL")
    computed = {
        name: F.expr(sql).alias(name) for name, sql in _point_columns("metric_type").items()
    }
    computed["dp_attrs"] = attrs_to_json("p.attributes").alias("dp_attrs")
    return points.select(
        *carried, *[computed.get(name, F.col(name)) for name in POINT_COLUMNS]
    )
