"""The registered queries and, for each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import attrs_to_json_folded, fmt_f64, format_labels, parse_labels, sanitize_metric
from ..operators import buckets, catalog, extracts, filters, naming, samples, series
from ..operators.flatten import flatten
from ..schema import KEY_VALUE, METRIC_SCHEMA, POINT_COLUMNS, TABLE_NAME
from ..sources import jsonl, points as tables, query as adhoc
from ..sources.arrival import in_order
from ..sources.otlp import accepted, parse_otlp, read_otlp, rejected
from ..sources.scratch import scratch_dir
from ..streaming.history import read_history, run_history
from ..streaming.ingest import Ingest, read_series
from ..streaming.latest import read_latest, run_latest
from ..streaming.rate import ingest_rate
from .derived import duckdb_cte, otlp_requests, otlp_texts, points, port_points, table
from .dimensions import TYPE_NAMES, sai_stats, sai_types, stat_rows, values_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(oracle: str, *ctes: str):
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        ORACLES[run.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + oracle
        return run

    return add


POINTS = duckdb_cte("points")
PORTS = duckdb_cte("port_points")
STATS = f"sai_stats(type_id, stat_id, stat_name) AS (VALUES {values_sql(stat_rows())})"
TYPES = f"sai_types(type_id, type_name) AS (VALUES {values_sql(list(TYPE_NAMES.items()))})"

# --- dashboard -----------------------------------------------------------------

FILTER = {
    "objects": ["Ethernet0", "Ethernet4"],
    "types": ["1", "24", "99"],
    "stats": [str(i) for i in range(10)],
}
START, END = "2024-01-01 00:10:00", "2024-01-01 02:00:00"


def _bucket_ctes(max_points: int, where: str = "", start: str = "", end: str = "") -> list[str]:
    def bound(text: str, extreme: str) -> str:
        given = f"epoch_us(TIMESTAMP '{text}') * 1000" if text else "NULL"
        return f"coalesce({given}, (SELECT {extreme}(timestamp_ns) FROM port_points))"

    width = f"greatest(1, (t1 - t0) // {max_points})" if max_points else "1"
    attr = "json_extract_string(dp_attrs, '$.{}')".format
    condition = "timestamp_ns BETWEEN t0 AND t1" + where
    return [
        f"bounds AS (SELECT {bound(start, 'min')} AS t0, {bound(end, 'max')} AS t1)",
        f"params AS (SELECT t0, t1, {width} AS b FROM bounds)",
        "grouped AS (SELECT (timestamp_ns // b) * b // 1000000000 AS time,"
        f" avg(value_int) AS value, {attr('object_name')} AS obj,"
        f" CAST({attr('sai_type_id')} AS BIGINT) AS tid,"
        f" CAST({attr('sai_stat_id')} AS BIGINT) AS sid"
        f" FROM port_points, params WHERE {condition} GROUP BY timestamp_ns // b, b, obj, tid, sid)",
        "dashboard AS (SELECT g.time, g.value, g.obj || '_' || coalesce(t.type_name, 'T' || g.tid)"
        " || '_' || coalesce(s.stat_name, 'stat' || g.sid) AS series FROM grouped g"
        " LEFT JOIN sai_types t ON g.tid = t.type_id"
        " LEFT JOIN sai_stats s ON g.tid = s.type_id AND g.sid = s.stat_id)",
    ]


def _dashboard(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    averages = buckets.bucket_avg(port_points(spark, sf_dir), **options)
    return naming.dashboard(averages, sai_types(spark), sai_stats(spark))


def _in_list(key: str, values: list[str]) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f" AND json_extract_string(dp_attrs, '$.{key}') IN ({listed})"


FILTER_SQL = "".join(_in_list(k, v) for k, v in zip(buckets.ATTRIBUTES, FILTER.values()))
ALL_DASH = "SELECT time, value, series FROM dashboard"


@_register(ALL_DASH, PORTS, STATS, TYPES, *_bucket_ctes(10))
def dash_bucket_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dashboard(spark, sf_dir, max_points=10)


@_register(ALL_DASH, PORTS, STATS, TYPES, *_bucket_ctes(1000, FILTER_SQL, START, END))
def dash_bucket_avg_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dashboard(spark, sf_dir, max_points=1000, start=START, end=END, **FILTER)


@_register(ALL_DASH, PORTS, STATS, TYPES, *_bucket_ctes(0))
def dash_bucket_avg_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dashboard(spark, sf_dir, max_points=0)


WIDE = ["Ethernet0_Port_IfInOctets", "Ethernet4_Queue_Bytes", "Ethernet8_T99_stat2"]


@_register(
    "SELECT time, "
    + ", ".join(f"avg(CASE WHEN series = '{s}' THEN value END) AS \"{s}\"" for s in WIDE)
    + " FROM dashboard GROUP BY time",
    PORTS, STATS, TYPES, *_bucket_ctes(10),
)
def dash_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.wide(_dashboard(spark, sf_dir, max_points=10), WIDE)


@_register(
    "SELECT t0 AS t_start, t1 AS t_end, b AS bucket FROM params", PORTS, *_bucket_ctes(100)[:2]
)
def dash_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    t_start, t_end = buckets.time_bounds(port_points(spark, sf_dir), "", "not a date")
    width = buckets.bucket_width(t_start, t_end, 100)
    return spark.range(1).select(
        t_start.alias("t_start"), t_end.alias("t_end"), width.alias("bucket")
    )


@_register(
    "SELECT DISTINCT json_extract_string(dp_attrs, '$.object_name') AS text FROM port_points",
    PORTS,
)
def dash_var_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.var_objects(port_points(spark, sf_dir))


@_register(
    "SELECT value, CASE CAST(value AS BIGINT) WHEN 1 THEN 'Port' WHEN 21 THEN 'Queue'"
    " WHEN 24 THEN 'BufferPool' WHEN 26 THEN 'IngressPriorityGroup'"
    " ELSE 'Type' || value END AS text FROM (SELECT DISTINCT"
    " json_extract_string(dp_attrs, '$.sai_type_id') AS value FROM port_points)",
    PORTS,
)
def dash_var_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.var_types(port_points(spark, sf_dir))


@_register(
    "SELECT CAST(m.sid AS VARCHAR) AS value, coalesce(s.stat_name, 'stat' || m.sid)"
    " || ' (' || m.sid || ')' AS text FROM (SELECT DISTINCT"
    " CAST(json_extract_string(dp_attrs, '$.sai_stat_id') AS BIGINT) AS sid,"
    " CAST(json_extract_string(dp_attrs, '$.sai_type_id') AS BIGINT) AS tid FROM port_points) m"
    " LEFT JOIN sai_stats s ON m.tid = s.type_id AND m.sid = s.stat_id",
    PORTS, STATS,
)
def dash_var_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.var_stats(port_points(spark, sf_dir), sai_stats(spark))


# --- catalogue and extracts ----------------------------------------------------


@_register(
    "SELECT metric_name, metric_type, count(*) AS count FROM points GROUP BY ALL", POINTS
)
def metric_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.metric_catalogue(points(spark, sf_dir))


@_register("SELECT metric_name, count(*) AS cnt FROM points GROUP BY ALL", POINTS)
def count_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.count_by_metric(points(spark, sf_dir))


@_register("SELECT DISTINCT metric_type FROM points", POINTS)
def metric_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.metric_types(points(spark, sf_dir))


@_register("SELECT count(*) AS cnt FROM points", POINTS)
def count_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.count_points(points(spark, sf_dir))


RANGE_NS = (1_704_500_000_000_000_000, 1_705_500_000_000_000_000)
IN_RANGE = f"timestamp_ns BETWEEN {RANGE_NS[0]} AND {RANGE_NS[1]}"


@_register(
    "SELECT timestamp_ns // 1000000000 AS time, value_double AS value FROM points"
    f" WHERE metric_name = 'app.view' AND {IN_RANGE}",
    POINTS,
)
def time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.time_series(points(spark, sf_dir), "app.view", *RANGE_NS)


@_register(
    "SELECT CAST(timestamp_ns AS DOUBLE) / 1e9 AS time, value_int AS value FROM points"
    " WHERE metric_name = 'app.click'",
    POINTS,
)
def time_series_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.time_series_float(points(spark, sf_dir), "app.click")


@_register(
    "SELECT timestamp_ns // 1000000000 AS time, hist_bounds, hist_counts,"
    " CAST(json_extract(hist_bounds, '$[3]') AS DOUBLE) AS top_bound,"
    " CAST(json_extract(hist_counts, '$[0]') AS BIGINT) AS first_count FROM points"
    f" WHERE metric_name = 'app.purchase' AND metric_type = 'histogram' AND {IN_RANGE}",
    POINTS,
)
def histogram_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extracts.histogram_rows(points(spark, sf_dir), "app.purchase", *RANGE_NS)
    return extracts.histogram_arrays(rows).select(
        "time",
        "hist_bounds",
        "hist_counts",
        F.get("bounds", F.lit(3)).alias("top_bound"),
        F.get("counts", F.lit(0)).cast("bigint").alias("first_count"),
    )


POINT_SQL = "SELECT * FROM points"


@_register(f"{POINT_SQL} ORDER BY id DESC LIMIT 5", POINTS)
def tail_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.tail(points(spark, sf_dir), 5)


@_register(f"{POINT_SQL} ORDER BY id LIMIT 10000", POINTS)
def head_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.head(points(spark, sf_dir))


@_register(f"{POINT_SQL} WHERE metric_name = 'app.error' ORDER BY timestamp_ns LIMIT 1", POINTS)
def first_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.first_point(points(spark, sf_dir), "app.error")


@_register(f"{POINT_SQL} ORDER BY id LIMIT 3000", POINTS)
def capped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracts.cap_rows(points(spark, sf_dir), max_rows=2500, batch_size=1000)


@_register("SELECT id, dp_attrs, value_int FROM points WHERE dp_attrs ILIKE '%NODE-1%'", POINTS)
def attr_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    matching = filters.attr_like(points(spark, sf_dir), "%NODE-1%")
    return matching.select("id", "dp_attrs", "value_int")


@_register(
    "SELECT id, metric_name, dp_attrs FROM points WHERE metric_name = 'app.click' AND metric_type"
    " = 'sum' AND json_extract_string(dp_attrs, '$.\"host.name\"') IN ('node-1', 'node-3')"
    f" AND {IN_RANGE}",
    POINTS,
)
def point_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = filters.metric(points(spark, sf_dir), "app.click", "sum")
    chosen = filters.time_range(chosen, *RANGE_NS)
    chosen = filters.attr_in(chosen, "host.name", ["node-1", "node-3"])
    return chosen.select("id", "metric_name", "dp_attrs")


# --- series --------------------------------------------------------------------

LABELS = (
    "CASE WHEN dp_attrs IS NULL THEN '' ELSE '{core=\"' || json_extract_string(dp_attrs, '$.core')"
    " || '\",host_name=\"' || json_extract_string(dp_attrs, '$.\"host.name\"') || '\"}' END"
)


def _samples_leg(name: str, value: str, where: str) -> str:
    return (
        f"SELECT id, {name} AS series_name, {LABELS} AS labels, dp_attrs,"
        f" CAST(timestamp_ns AS DOUBLE) / 1e9 AS timestamp, {value} AS value, metric_type"
        f" FROM points WHERE {where}"
    )


SAMPLES = "samples AS (" + " UNION ALL ".join(
    [
        _samples_leg("metric_name || '_sum'", "hist_sum",
                     "metric_type = 'histogram' AND hist_sum IS NOT NULL"),
        _samples_leg("metric_name || '_count'", "CAST(hist_count AS DOUBLE)",
                     "metric_type = 'histogram' AND hist_count IS NOT NULL"),
        _samples_leg("metric_name", "coalesce(value_double, CAST(value_int AS DOUBLE), 0.0)",
                     "metric_type <> 'histogram'"),
    ]
) + ")"
LATEST = (
    "latest AS (SELECT series_name, labels, any_value(dp_attrs) AS dp_attrs,"
    " arg_max(timestamp, id) AS timestamp, arg_max(value, id) AS value,"
    " arg_min(metric_type, id) AS metric_type, min(id) AS first_id, max(id) AS last_id"
    " FROM samples GROUP BY series_name, labels)"
)
CUTOFF = 1_705_000_000
HISTORY = (
    "history AS (SELECT * FROM (SELECT *, min(id) FILTER (WHERE timestamp >= {cutoff})"
    " OVER (PARTITION BY series_name, labels) AS first_kept FROM {source})"
    " WHERE id >= first_kept)"
)
SANITIZED = "regexp_replace(series_name, '[^A-Za-z0-9_:]', '_', 'g')"
NUMBER = "regexp_replace(CAST(value AS VARCHAR), '\\.0$', '')"


def _with_label_text(df: DataFrame) -> DataFrame:
    return df.withColumn("labels", format_labels("labels"))


@_register("SELECT id, series_name, labels, timestamp, value, metric_type FROM samples",
           POINTS, SAMPLES)
def series_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_label_text(samples.to_samples(points(spark, sf_dir)))


LATEST_COLUMNS = "series_name, labels, timestamp, value, metric_type, first_id, last_id"


@_register(f"SELECT {LATEST_COLUMNS} FROM latest", POINTS, SAMPLES, LATEST)
def series_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_label_text(series.latest_per_series(points(spark, sf_dir)))


PROM_TYPE = "CASE WHEN metric_type = 'sum' THEN 'counter' ELSE 'gauge' END"


@_register(
    f"SELECT '# TYPE ' || {SANITIZED} || ' ' || {PROM_TYPE} AS line FROM (SELECT series_name,"
    " arg_min(metric_type, first_id) AS metric_type FROM latest GROUP BY series_name)"
    f" UNION ALL SELECT {SANITIZED} || labels || ' ' || {NUMBER} FROM latest",
    POINTS, SAMPLES, LATEST,
)
def series_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.exposition(points(spark, sf_dir))


@_register(f"SELECT DISTINCT {SANITIZED} AS name FROM samples", POINTS, SAMPLES)
def series_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.metric_names(points(spark, sf_dir))


@_register(
    "SELECT '__name__' AS label UNION SELECT regexp_replace(unnest(json_keys(dp_attrs)),"
    " '[^A-Za-z0-9_]', '_', 'g') FROM samples",
    POINTS, SAMPLES,
)
def series_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.label_names(points(spark, sf_dir))


HISTORY_COLUMNS = "id, series_name, labels, timestamp, value, metric_type"


@_register(
    f"SELECT {HISTORY_COLUMNS} FROM history",
    POINTS, SAMPLES, HISTORY.format(cutoff=CUTOFF, source="samples"),
)
def series_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_label_text(series.series_history(points(spark, sf_dir), cutoff=CUTOFF))


@_register(
    f"SELECT {HISTORY_COLUMNS} FROM history",
    POINTS, SAMPLES,
    "cut AS (SELECT *, max(timestamp + 60.0) OVER (PARTITION BY series_name, labels)"
    " - 864000.0 AS cutoff FROM samples)",
    HISTORY.format(cutoff="cutoff", source="cut"),
)
def series_history_by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = points(spark, sf_dir).withColumn(
        "arrived", F.expr("CAST(timestamp_ns AS DOUBLE) / 1e9D + 60.0D")
    )
    return _with_label_text(series.series_history(late, retention=864_000.0, arrival="arrived"))


SELECTED = f"{SANITIZED} = 'app_view' AND labels LIKE '%host_name=\"node-1\"%'"
RESULT_SQL = (
    f"SELECT {{id}}{SANITIZED} AS name, labels, timestamp, value, '{{{{\"__name__\":\"app_view\","
    "\"core\":\"' || json_extract_string(dp_attrs, '$.core') || '\",\"host_name\":\"node-1\"}}'"
    f" AS metric, '[' || timestamp || ',\"' || {NUMBER} || '\"]' AS point FROM {{source}}"
    f" WHERE {SELECTED}{{more}}"
)
SELECTION = {"name": "app.view", "labels": {"host_name": "node-1"}}
RANGE = (1_704_500_000.0, 1_705_500_000.0)


# Late enough that some series hold no sample any more.
LATE_CUTOFF = 1_706_656_000
RETAINED = (
    "(series_name, labels) IN (SELECT (series_name, labels) FROM samples"
    f" WHERE timestamp >= {LATE_CUTOFF})"
)


def _named_result(df: DataFrame) -> DataFrame:
    return _with_label_text(df.drop("series_name"))


@_register(RESULT_SQL.format(id="", source="latest", more=""), POINTS, SAMPLES, LATEST)
def series_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named_result(series.instant(points(spark, sf_dir), **SELECTION))


@_register(
    RESULT_SQL.format(id="", source="latest", more=f" AND {RETAINED}"),
    POINTS, SAMPLES, LATEST,
)
def series_instant_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named_result(
        series.instant(points(spark, sf_dir), **SELECTION, cutoff=LATE_CUTOFF)
    )


@_register(
    f"SELECT '# TYPE ' || {SANITIZED} || ' ' || {PROM_TYPE} AS line FROM (SELECT series_name,"
    " arg_min(metric_type, first_id) AS metric_type FROM latest GROUP BY series_name)"
    f" UNION ALL SELECT {SANITIZED} || labels || ' ' || {NUMBER} FROM latest WHERE {RETAINED}",
    POINTS, SAMPLES, LATEST,
)
def series_exposition_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.exposition(points(spark, sf_dir), cutoff=LATE_CUTOFF)


@_register(
    RESULT_SQL.format(
        id="id, ", source="history", more=f" AND timestamp BETWEEN {RANGE[0]} AND {RANGE[1]}"
    ),
    POINTS, SAMPLES, HISTORY.format(cutoff=CUTOFF, source="samples"),
)
def series_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.range_(
        points(spark, sf_dir), **SELECTION, start=RANGE[0], end=RANGE[1], cutoff=CUTOFF
    )
    return _named_result(rows)


@_register(
    "SELECT 'success' AS status, 'matrix' AS \"resultType\", chunk, '{\"metric\":' || min(metric) ||"
    " ',\"values\":[' || string_agg(point, ',' ORDER BY id) || ']}' AS result FROM"
    " (SELECT *, (row_number() OVER (PARTITION BY labels ORDER BY id) - 1) // 50 AS chunk FROM found)"
    " GROUP BY labels, chunk",
    POINTS, SAMPLES, HISTORY.format(cutoff=CUTOFF, source="samples"),
    "found AS ("
    + RESULT_SQL.format(
        id="id, ", source="history", more=f" AND timestamp BETWEEN {RANGE[0]} AND {RANGE[1]}"
    )
    + ")",
)
def series_range_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.range_(
        points(spark, sf_dir), **SELECTION, start=RANGE[0], end=RANGE[1], cutoff=CUTOFF
    )
    return series.matrix(rows, samples=50)


@_register(RESULT_SQL.format(id="", source="latest", more=""), POINTS, SAMPLES, LATEST)
def series_range_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named_result(series.range_(points(spark, sf_dir), **SELECTION, start=0.0, end=1.0))


@_register(
    "SELECT 'success' AS status, 'vector' AS \"resultType\", '{\"metric\":' || metric ||"
    " ',\"value\":' || point || '}' AS result FROM found",
    POINTS, SAMPLES, LATEST,
    f"found AS ({RESULT_SQL.format(id='', source='latest', more='')})",
)
def series_instant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.envelope(series.instant(points(spark, sf_dir), **SELECTION), "vector")


LABEL_TEXT = (
    "'{\"n\":' || props || ',\"x\":' || CAST(value AS STRING) || '0,\"b\":true,\"u\":null,\"t.s\":\"'"
    " || event_type || '\"}'"
)


@_register(
    "SELECT event_id, '{b=\"true\",n=\"' || replace(replace(props, ' ', ''), '\"', '\\\"') ||"
    " '\",t_s=\"' || event_type || '\",u=\"null\",x=\"' || CAST(value AS VARCHAR) || '\"}' AS labels"
    " FROM events"
)
def label_value_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "events").selectExpr("event_id", f"{LABEL_TEXT} AS text")
    parsed = texts.select("event_id", parse_labels("text").alias("labels"))
    return _with_label_text(parsed)


@_register(
    "SELECT event_id, regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS number,"
    " regexp_replace(event_type || '.' || event_id || ' é', '[^A-Za-z0-9_:]', '_', 'g') AS name"
    " FROM events"
)
def number_and_name_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        fmt_f64("value").alias("number"),
        sanitize_metric("concat(event_type, '.', event_id, ' é')").alias("name"),
    )


# --- requests ------------------------------------------------------------------

FLAT = f"SELECT {', '.join(POINT_COLUMNS)} FROM points"


@_register(FLAT, POINTS)
def otlp_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(otlp_requests(spark, sf_dir))


def _attribute_list() -> str:
    # Members differ in type, so they are encoded one by one.
    items = [
        "named_struct('key', 's', 'value', named_struct('stringValue', props))",
        "named_struct('key', 'i', 'value', named_struct('stringValue', 'replaced'))",
        "named_struct('key', 'i', 'value', named_struct('intValue', CAST(event_id AS STRING)))",
        "named_struct('key', 'b', 'value', named_struct('boolValue', event_id % 2 = 0))",
        "named_struct('key', 'd', 'value', named_struct('doubleValue', value))",
        "named_struct('key', 'big', 'value', named_struct('doubleValue', value * 1e15D))",
        "named_struct('key', 'by', 'value', named_struct('bytesValue',"
        " base64(CAST(event_type AS BINARY))))",
        "named_struct('key', 'arr', 'value', named_struct('arrayValue', named_struct('values',"
        " array(named_struct('stringValue', event_type, 'intValue', CAST(NULL AS STRING)),"
        " named_struct('stringValue', CAST(NULL AS STRING), 'intValue',"
        " CAST(user_id AS STRING))))))",
        "named_struct('key', 'kv', 'value', named_struct('kvlistValue', named_struct('values',"
        " array(named_struct('key', 'z', 'value', named_struct('doubleValue', value,"
        " 'stringValue', CAST(NULL AS STRING))),"
        " named_struct('key', 'a', 'value', named_struct('doubleValue', CAST(NULL AS DOUBLE),"
        " 'stringValue', event_type))))))",
        "named_struct('key', 'none')",
    ]
    encoded = ", ".join(f"to_json({item})" for item in items)
    return f"concat('[', concat_ws(',', {encoded}), ']')"


@_register(
    "SELECT event_id, '{\"arr\":[\"' || event_type || '\",' || user_id || '],\"b\":'"
    " || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',\"big\":'"
    " || replace(CAST(value * 1e15 AS VARCHAR), 'e+', 'e') || ',\"by\":\"'"
    " || lower(hex(encode(event_type))) || '\",\"d\":' || CAST(value AS VARCHAR) || ',\"i\":'"
    " || event_id || ',\"kv\":{\"a\":\"' || event_type || '\",\"z\":' || CAST(value AS VARCHAR)"
    " || '},\"none\":null,\"s\":' || CAST(to_json(props) AS VARCHAR) || '}' AS attrs FROM events"
)
def otlp_attr_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "events").select(
        "event_id",
        F.from_json(F.expr(_attribute_list()), f"array<{KEY_VALUE.simpleString()}>").alias("kvs"),
    )
    return lists.select("event_id", attrs_to_json_folded("kvs").alias("attrs"))


# Two levels, an array that holds a key-value list, as often as the event says: up to 16 levels.
_DEEP = ('{"arrayValue":{"values":[{"kvlistValue":{"values":[{"key":"k","value":', '}]}},{"intValue":"', '"}]}}')


@_register(
    "SELECT event_id, '{\"deep\":' || repeat('[{\"k\":', CAST(event_id % 9 AS BIGINT)) || '\"' || event_type"
    " || '\"' || repeat('},' || event_id || ']', CAST(event_id % 9 AS BIGINT)) || '}' AS attrs FROM events"
)
def otlp_deep_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = "CAST(event_id % 9 AS INT)"
    value = (
        f"concat(repeat('{_DEEP[0]}', {times}), '{{\"stringValue\":\"', event_type, '\"}}',"
        f" repeat(concat('{_DEEP[1]}', CAST(event_id AS STRING), '{_DEEP[2]}'), {times}))"
    )
    texts = table(spark, sf_dir, "events").selectExpr(
        "event_id", f"concat('[{{\"key\":\"deep\",\"value\":', {value}, '}}]') AS text"
    )
    lists = texts.select("event_id", F.from_json("text", f"array<{KEY_VALUE.simpleString()}>").alias("kvs"))
    return lists.select("event_id", attrs_to_json_folded("kvs").alias("attrs"))


@_register(
    "SELECT block, CASE block % 5 WHEN 1 THEN 'not a request' WHEN 2 THEN 'unreadable number' END AS reason,"
    " CASE WHEN block % 5 IN (1, 2) THEN 0 ELSE count(*) END AS points"
    " FROM (SELECT event_id // 100 AS block FROM events) GROUP BY block"
)
def otlp_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of requests of which some are cut off and some give a time that is no number."""
    texts = otlp_texts(spark, sf_dir).withColumn(
        "value",
        F.expr(
            "CASE block % 5 WHEN 1 THEN substring(value, 1, length(value) - 3)"
            " WHEN 2 THEN replace(value, '\"timeUnixNano\":\"', '\"timeUnixNano\":\"x') ELSE value END"
        ),
    )
    flat = flatten(parse_otlp(texts), keep=["block"], rejects=True)
    good = accepted(flat).groupBy("block").agg(F.count("*").alias("points"))
    bad = rejected(flat, "block").groupBy("block", "reason").agg(F.count("line").alias("lines"))
    return good.select("block", F.lit(None).cast("string").alias("reason"), "points").unionByName(
        bad.where("lines = 1").select("block", "reason", F.lit(0).cast("long").alias("points"))
    )


# --- sources and sinks ---------------------------------------------------------


@_register(FLAT, POINTS)
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    jsonl.write_jsonl(points(spark, sf_dir), path)
    return jsonl.read_jsonl(spark, path)


@_register(POINT_SQL, POINTS)
def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended in two batches; the ids given on arrival equal those of the input."""
    path = scratch_dir(spark)
    arriving = in_order(points(spark, sf_dir), "id")
    half = points(spark, sf_dir).agg(F.max("id")).first()[0] // 2
    tables.append_points(arriving.where(F.col("id") <= half).drop("id"), path)
    tables.append_points(arriving.where(F.col("id") > half).drop("id"), path)
    return tables.read_points(spark, path)


@_register(f"{POINT_SQL} WHERE metric_type = 'gauge' AND {IN_RANGE}", POINTS)
def analysis_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    tables.write_analysis_layout(points(spark, sf_dir), path)
    laid_out = tables.read_points(spark, path).where("metric_type = 'gauge'")
    return filters.time_range(laid_out, *RANGE_NS)


SECONDS = "timestamp_ns // 5000000000 * 5"


@_register(
    f"SELECT {SECONDS} AS window_start, count(*) AS rows, count(*) / 5.0 AS rows_per_second"
    f" FROM points GROUP BY {SECONDS}",
    POINTS,
)
def ingest_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrivals = points(spark, sf_dir).selectExpr("timestamp_micros(timestamp_ns div 1000) AS ts")
    return ingest_rate(arrivals, "ts").withColumn(
        "window_start", F.unix_timestamp("window_start")
    )


@_register("SELECT metric_name, count(*) AS cnt FROM points GROUP BY ALL", POINTS)
def query_api_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    points(spark, sf_dir).createOrReplaceTempView(TABLE_NAME)
    return adhoc.query(
        spark,
        f"SELECT metric_name, count(*) AS cnt FROM {TABLE_NAME}"
        " GROUP BY metric_name ORDER BY cnt DESC",
    )


@_register(
    "SELECT '{\"dp_attrs\":' || coalesce(CAST(to_json(dp_attrs) AS VARCHAR), 'null')"
    " || ',\"id\":' || id || ',\"is_monotonic\":' || CASE WHEN is_monotonic THEN '1' ELSE 'null' END"
    " || ',\"timestamp_ns\":' || timestamp_ns || ',\"value_double\":'"
    " || coalesce(regexp_replace(CAST(value_double AS VARCHAR), '\\.0$', ''), 'null')"
    " || ',\"value_int\":' || coalesce(CAST(value_int AS VARCHAR), 'null') || '}' AS row"
    " FROM (SELECT * FROM points ORDER BY id LIMIT 10000)",
    POINTS,
)
def query_api_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    points(spark, sf_dir).createOrReplaceTempView(TABLE_NAME)
    found = adhoc.query(
        spark,
        "WITH p AS (SELECT * FROM metric_data_points) SELECT timestamp_ns, id, value_double,"
        " value_int, is_monotonic, dp_attrs FROM p ORDER BY id",
    )
    return adhoc.rows_as_json(found)


# --- streams -------------------------------------------------------------------


def _written(df: DataFrame, path: str, order: str, writer: str) -> int:
    """Write in range order; give the number of files for about four triggers."""
    ordered = df.repartitionByRange(order).sortWithinPartitions(order)
    if writer == "text":
        ordered = ordered.select("value")
    getattr(ordered.write, writer)(path)
    files = df.sparkSession.read.format(writer).load(path).inputFiles()
    return max(1, -(-len(files) // 4))


def _point_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    per_trigger = _written(points(spark, sf_dir), path, "id", "parquet")
    reader = spark.readStream.schema(METRIC_SCHEMA).option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


@_register(FLAT, POINTS)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests through all three sinks; the table is returned."""
    base = scratch_dir(spark)
    per_trigger = _written(otlp_texts(spark, sf_dir), f"{base}/in", "block", "text")
    requests = read_otlp(spark, f"{base}/in", streaming=True, maxFilesPerTrigger=per_trigger)
    ingest = Ingest(
        f"{base}/checkpoint",
        table=f"{base}/table",
        jsonl=f"{base}/jsonl",
        series=f"{base}/series",
    )
    ingest.run(requests, available_now=True).awaitTermination()
    return tables.read_points(spark, f"{base}/table").drop("id")


@_register(f"SELECT {LATEST_COLUMNS} FROM latest", POINTS, SAMPLES, LATEST)
def stream_ingest_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series changes of an ingest. Points bring their ids, so any file order will do."""
    base = scratch_dir(spark)
    ingest = Ingest(f"{base}/checkpoint", series=f"{base}/series")
    ingest.run(_point_stream(spark, sf_dir), available_now=True).awaitTermination()
    return _with_label_text(read_series(spark, f"{base}/series"))


@_register(f"SELECT {LATEST_COLUMNS} FROM latest", POINTS, SAMPLES, LATEST)
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark)
    stream = _point_stream(spark, sf_dir)
    run_latest(stream, f"{base}/out", f"{base}/cp", available_now=True).awaitTermination()
    return _with_label_text(read_latest(spark, f"{base}/out"))


@_register(
    f"SELECT {HISTORY_COLUMNS} FROM history",
    POINTS, SAMPLES, HISTORY.format(cutoff=CUTOFF, source="samples"),
)
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark)
    ingest = Ingest(f"{base}/cp", table=f"{base}/table")
    ingest.run(_point_stream(spark, sf_dir), available_now=True).awaitTermination()
    stored = tables.read_points(spark, f"{base}/table")
    return _with_label_text(series.series_history(stored, cutoff=CUTOFF))


@_register(
    f"SELECT {HISTORY_COLUMNS} FROM history",
    POINTS, SAMPLES, HISTORY.format(cutoff=CUTOFF, source="samples"),
)
def stream_history_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retained samples out of a stream's state, after a restart half-way."""
    base = scratch_dir(spark)
    rows = points(spark, sf_dir)
    middle = rows.agg(F.avg("id").alias("middle")).scalar()
    for part in (F.col("id") <= middle, F.col("id") > middle):
        rows.where(part).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(METRIC_SCHEMA).parquet(f"{base}/in")
        run_history(stream, f"{base}/cp", cutoff=CUTOFF, available_now=True).awaitTermination()
    return _with_label_text(read_history(spark, f"{base}/cp"))
