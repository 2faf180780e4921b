"""Inputs derived from the benchmark tables, as text both engines understand.

``{epoch_us}`` is the only placeholder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.otlp import parse_otlp

_EPOCH_US = {
    "spark": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)",
    "duckdb": "epoch_us(ts)",
}

_BLOCK = "CAST(floor(event_id / 100) AS BIGINT)"
_COUNTED = "event_type IN ('purchase','error','signup')"
_START = "1704067200000000000"

# Points from events: five event types stand for the five metric kinds, and each
# block of 200 events arrives reversed, so arrival order is not time order.
POINTS = {
    "id": "(event_id - event_id % 200) + (199 - event_id % 200) + 1",
    "timestamp_ns": "{epoch_us} * 1000 + event_id % 1000",
    "metric_name": "'app.' || event_type",
    "metric_type": (
        "CASE event_type WHEN 'view' THEN 'gauge' WHEN 'click' THEN 'sum'"
        " WHEN 'purchase' THEN 'histogram' WHEN 'error' THEN 'exp_histogram'"
        " ELSE 'summary' END"
    ),
    "resource_attrs": f"""'{{"service.name":"svc-' || CAST({_BLOCK} % 3 AS STRING) || '"}}'""",
    "scope_name": "'meter'",
    "scope_version": f"CASE WHEN {_BLOCK} % 2 = 1 THEN '1.0' END",
    "dp_attrs": (
        """CASE WHEN event_id % 10 <> 0 THEN '{"core":' || CAST(user_id % 2 AS STRING)"""
        """ || ',"host.name":"node-' || CAST(user_id % 4 AS STRING) || '"}' END"""
    ),
    "value_double": "CASE WHEN event_type = 'view' AND event_id % 50 <> 1 THEN value END",
    "value_int": "CASE WHEN event_type = 'click' THEN CAST(round(value * 100) AS BIGINT) END",
    "is_monotonic": "CASE WHEN event_type = 'click' THEN true END",
    "aggregation_temporality": (
        "CASE event_type WHEN 'click' THEN 2 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 END"
    ),
    "hist_count": f"CASE WHEN {_COUNTED} THEN event_id % 97 + 1 END",
    "hist_sum": f"CASE WHEN {_COUNTED} THEN value END",
    "hist_min": "CASE WHEN event_type IN ('purchase','error') THEN CAST(0.5 AS DOUBLE) END",
    "hist_max": "CASE WHEN event_type IN ('purchase','error') THEN value END",
    "hist_bounds": "CASE WHEN event_type = 'purchase' THEN '[1.0,5.0,10.0,50.0]' END",
    "hist_counts": (
        "CASE WHEN event_type = 'purchase' THEN '[' || CAST(event_id % 5 AS STRING) || ','"
        " || CAST(event_id % 7 AS STRING) || ',3,' || CAST(event_id % 11 AS STRING)"
        " || ',0]' END"
    ),
    "extra_data": (
        """CASE WHEN event_type = 'error' THEN '{"negative":null,"positive":{"bucket_counts":['"""
        """ || CAST(event_id % 5 AS STRING) || ',' || CAST(event_id % 7 AS STRING)"""
        """ || '],"offset":0},"scale":3,"zero_count":' || CAST(event_id % 3 AS STRING)"""
        """ || ',"zero_threshold":0.0}'"""
        """ WHEN event_type = 'signup' THEN '[{"quantile":0.5,"value":'"""
        """ || CAST(value AS STRING) || '},{"quantile":0.99,"value":150.0}]' END"""
    ),
    "start_timestamp_ns": (
        f"CASE WHEN event_type IN ('click','purchase','error') THEN {_START} END"
    ),
    "flags": "CAST(event_id % 2 AS INT)",
}

# Switch counters from lineitem: a 250 ms grid, string attributes, no id.
PORT_POINTS = {
    "timestamp_ns": (
        f"{_START} + (l_orderkey * 7 + l_linenumber) * 250000000 + l_linenumber"
    ),
    "metric_name": "'port.counter'",
    "metric_type": "'gauge'",
    "dp_attrs": (
        """'{"object_name":"Ethernet' || CAST((l_suppkey % 8) * 4 AS STRING)"""
        """ || '","sai_stat_id":"' || CAST(l_partkey % 48 AS STRING) || '","sai_type_id":"'"""
        """ || CASE l_linenumber % 5 WHEN 0 THEN '1' WHEN 1 THEN '21' WHEN 2 THEN '24'"""
        """ WHEN 3 THEN '26' ELSE '99' END || '"}'"""
    ),
    "value_int": "CAST(l_quantity AS BIGINT)",
}


def _columns(columns: dict[str, str], engine: str) -> list[str]:
    return [
        f"{sql.replace('{epoch_us}', _EPOCH_US[engine])} AS {name}"
        for name, sql in columns.items()
    ]


def duckdb_cte(name: str) -> str:
    """``name AS (SELECT ...)`` for the oracle: ``points`` or ``port_points``."""
    columns, table = {"points": (POINTS, "events"), "port_points": (PORT_POINTS, "lineitem")}[name]
    return f"{name} AS (SELECT {', '.join(_columns(columns, 'duckdb'))} FROM {table})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_columns(POINTS, "spark"))


def port_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_columns(PORT_POINTS, "spark"))


def _point_json() -> str:
    """One event as a metric with one data point, in the request encoding."""
    text = "CAST({} AS STRING)"
    attributes = (
        "CASE WHEN event_id % 10 <> 0 THEN array("
        "named_struct('key', 'host.name', 'value',"
        " named_struct('stringValue', concat('node-', CAST(user_id % 4 AS STRING)),"
        " 'intValue', CAST(NULL AS STRING))),"
        "named_struct('key', 'core', 'value',"
        " named_struct('stringValue', CAST(NULL AS STRING),"
        " 'intValue', CAST(user_id % 2 AS STRING)))) END"
    )

    def point(*fields: tuple[str, str]) -> str:
        common = [
            ("attributes", attributes),
            ("timeUnixNano", text.format("timestamp_ns")),
            ("startTimeUnixNano", text.format("start_timestamp_ns")),
            ("flags", "flags"),
        ]
        body = ", ".join(f"'{k}', {v}" for k, v in [*common, *fields])
        return f"array(named_struct({body}))"

    count = ("count", text.format("hist_count"))
    counts = "transform(from_json(hist_counts, 'array<bigint>'), x -> CAST(x AS STRING))"
    distribution = [count, ("sum", "hist_sum"), ("min", "hist_min"), ("max", "hist_max")]
    kinds = {
        ("view", "gauge"): f"'dataPoints', {point(('asDouble', 'value_double'))}",
        ("click", "sum"): (
            "'aggregationTemporality', 2, 'isMonotonic', true,"
            f" 'dataPoints', {point(('asInt', text.format('value_int')))}"
        ),
        ("purchase", "histogram"): (
            "'aggregationTemporality', 1, 'dataPoints', "
            + point(
                *distribution,
                ("bucketCounts", counts),
                ("explicitBounds", "array(1.0D, 5.0D, 10.0D, 50.0D)"),
            )
        ),
        ("error", "exponentialHistogram"): (
            "'aggregationTemporality', 2, 'dataPoints', "
            + point(
                *distribution,
                ("scale", "3"),
                ("zeroCount", text.format("event_id % 3")),
                (
                    "positive",
                    "named_struct('offset', 0, 'bucketCounts',"
                    " array(CAST(event_id % 5 AS STRING), CAST(event_id % 7 AS STRING)))",
                ),
            )
        ),
        ("signup", "summary"): "'dataPoints', "
        + point(
            count,
            ("sum", "hist_sum"),
            (
                "quantileValues",
                "array(named_struct('quantile', 0.5D, 'value', hist_sum),"
                " named_struct('quantile', 0.99D, 'value', 150.0D))",
            ),
        ),
    }
    legs = ", ".join(
        f"'{kind}', CASE WHEN event_type = '{event}' THEN named_struct({body}) END"
        for (event, kind), body in kinds.items()
    )
    return f"to_json(named_struct('name', metric_name, {legs}))"


def otlp_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, value): one request text per block of 100 events, points in arrival order.

    A block has at most 100 events, so its group stays small at any scale.
    """
    per_event = (
        table(spark, sf_dir, "events")
        .selectExpr("event_id", "user_id", "event_type", *_columns(POINTS, "spark"))
        .selectExpr(
            f"{_BLOCK} AS block", "id", f"{_point_json()} AS metric"
        )
    )
    metrics = F.array_sort(F.collect_list(F.struct("id", "metric")))
    blocks = per_event.groupBy("block").agg(metrics.alias("metrics"))
    request = (
        """concat('{"resourceMetrics":[{"resource":{"attributes":[{"key":"service.name",',"""
        """ '"value":{"stringValue":"svc-', CAST(block % 3 AS STRING), '"}}]},"scopeMetrics":',"""
        """ '[{"scope":{"name":"meter","version":"', CASE WHEN block % 2 = 1 THEN '1.0' ELSE ''"""
        """ END, '"},"metrics":[', array_join(metrics.metric, ','), ']}]}]}')"""
    )
    return blocks.selectExpr("block", f"{request} AS value")


def otlp_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_otlp(otlp_texts(spark, sf_dir))

