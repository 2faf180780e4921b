"""Nested requests to flat points, kind by kind."""

import json

import pytest

from metricloom.operators.flatten import flatten
from metricloom.schema import POINT_COLUMNS, POINT_SCHEMA
from metricloom.sources.otlp import parse_otlp


def request(*metrics, attributes=True, scope=True, version="1.0"):
    resource = {"attributes": [{"key": "service.name", "value": {"stringValue": "test-svc"}}]}
    scoped = {"metrics": list(metrics)}
    if scope:
        scoped["scope"] = {"name": "test-scope", "version": version}
    return {
        "resourceMetrics": [
            {**({"resource": resource} if attributes else {}), "scopeMetrics": [scoped]}
        ]
    }


def host(value="node-1", key="host"):
    return [{"key": key, "value": {"stringValue": value}}]


@pytest.fixture(scope="module")
def run(spark):
    def flattened(*requests):
        df = spark.createDataFrame([(json.dumps(r),) for r in requests], "value string")
        return [r.asDict() for r in flatten(parse_otlp(df)).collect()]

    return flattened


def test_gauge(run):
    point = {"attributes": host(), "timeUnixNano": "1000000000", "asDouble": 72.5}
    (row,) = run(request({"name": "cpu.usage", "gauge": {"dataPoints": [point]}}))
    assert list(row) == POINT_COLUMNS
    expected = dict.fromkeys(POINT_COLUMNS) | {
        "timestamp_ns": 10**9, "metric_name": "cpu.usage", "metric_type": "gauge",
        "resource_attrs": '{"service.name":"test-svc"}', "scope_name": "test-scope",
        "scope_version": "1.0", "dp_attrs": '{"host":"node-1"}', "value_double": 72.5, "flags": 0,
    }
    assert row == expected


def test_schema(spark):
    df = spark.createDataFrame([("{}",)], "value string")
    got = flatten(parse_otlp(df)).schema
    assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in POINT_SCHEMA]


def test_sum_with_two_points(run):
    points = [
        {"attributes": host(m, "method"), "timeUnixNano": "2000000000",
         "startTimeUnixNano": "500000000", "asInt": v}
        for m, v in (("GET", "42"), ("POST", 10))
    ]
    rows = run(
        request(
            {"name": "http.requests",
             "sum": {"dataPoints": points, "isMonotonic": True, "aggregationTemporality": 2}}
        )
    )
    assert [(r["value_int"], r["dp_attrs"]) for r in rows] == [
        (42, '{"method":"GET"}'), (10, '{"method":"POST"}'),
    ]
    for r in rows:
        assert (r["metric_type"], r["is_monotonic"], r["aggregation_temporality"]) == ("sum", True, 2)
        assert r["value_double"] is None and r["start_timestamp_ns"] == 500_000_000


def test_sum_defaults(run):
    (row,) = run(request({"name": "s", "sum": {"dataPoints": [{"asInt": "1"}]}}))
    assert (row["is_monotonic"], row["aggregation_temporality"], row["timestamp_ns"]) == (False, 0, 0)


def test_enum_names(run):
    temporality = "AGGREGATION_TEMPORALITY_DELTA"
    (row,) = run(
        request({"name": "s", "sum": {"dataPoints": [{}], "aggregationTemporality": temporality}})
    )
    assert row["aggregation_temporality"] == 1


def test_point_without_value(run):
    (row,) = run(request({"name": "g", "gauge": {"dataPoints": [{"timeUnixNano": "5"}]}}))
    assert row["value_double"] is None and row["value_int"] is None


def test_histogram(run):
    point = {
        "timeUnixNano": "3000000000", "count": "100", "sum": 5000.0, "min": 0.5, "max": 99.0,
        "bucketCounts": ["10", "30", "40", "15", "5"], "explicitBounds": [1.0, 5.0, 10.0, 50.0],
    }
    (row,) = run(
        request({"name": "request.duration",
                 "histogram": {"dataPoints": [point], "aggregationTemporality": 1}})
    )
    assert row["metric_type"] == "histogram" and row["aggregation_temporality"] == 1
    assert [row[f"hist_{c}"] for c in ("count", "sum", "min", "max")] == [100, 5000.0, 0.5, 99.0]
    assert row["hist_bounds"] == "[1.0,5.0,10.0,50.0]"
    assert row["hist_counts"] == "[10,30,40,15,5]"
    assert row["value_double"] is None and row["extra_data"] is None and row["dp_attrs"] is None


def test_histogram_number_text_and_defaults(run):
    point = {"explicitBounds": [1e7, 1e21, 0.00001, 1.5e-7], "bucketCounts": ["18446744073709551615"]}
    full, bare = run(
        request(
            {"name": "h", "histogram": {"dataPoints": [point, {}]}},
        )
    )
    assert full["hist_bounds"] == "[10000000.0,1e21,0.00001,1.5e-7]"
    assert full["hist_counts"] == "[18446744073709551615]"
    assert (bare["hist_bounds"], bare["hist_counts"]) == ("[]", "[]")
    assert (bare["hist_count"], bare["hist_sum"], bare["hist_min"]) == (0, None, None)


def test_exponential_histogram(run):
    point = {
        "timeUnixNano": "4", "count": "50", "sum": 250.0, "scale": 3, "zeroCount": "2",
        "positive": {"bucketCounts": ["5", "10", "15"]},
        "negative": {"offset": -1, "bucketCounts": ["3", "7"]}, "min": 0.1, "max": 20.0,
    }
    rows = run(
        request(
            {"name": "latency",
             "exponentialHistogram": {"dataPoints": [point, {}], "aggregationTemporality": 2}}
        )
    )
    assert rows[0]["metric_type"] == "exp_histogram"
    assert rows[0]["extra_data"] == (
        '{"negative":{"bucket_counts":[3,7],"offset":-1},'
        '"positive":{"bucket_counts":[5,10,15],"offset":0},'
        '"scale":3,"zero_count":2,"zero_threshold":0.0}'
    )
    assert rows[0]["hist_bounds"] is None and rows[0]["hist_max"] == 20.0
    assert rows[1]["extra_data"] == (
        '{"negative":null,"positive":null,"scale":0,"zero_count":0,"zero_threshold":0.0}'
    )


def test_summary(run):
    point = {
        "timeUnixNano": "4", "count": "200", "sum": 10000.0,
        "quantileValues": [{"quantile": 0.5, "value": 50}, {"quantile": 0.99, "value": 150.0}],
    }
    full, bare = run(request({"name": "rpc.duration", "summary": {"dataPoints": [point, {}]}}))
    assert full["extra_data"] == '[{"quantile":0.5,"value":50.0},{"quantile":0.99,"value":150.0}]'
    assert (full["hist_count"], full["hist_sum"], full["hist_min"]) == (200, 10000.0, None)
    assert full["aggregation_temporality"] is None
    assert (bare["extra_data"], bare["hist_count"], bare["hist_sum"]) == ("[]", 0, 0.0)


@pytest.mark.parametrize(
    "empty",
    [{}, {"resourceMetrics": []}, request(), request({"name": "no data"}),
     request({"name": "g", "gauge": {}}), request({"name": "g", "gauge": {"dataPoints": []}})],
)
def test_empty_levels_yield_nothing(run, empty):
    assert run(empty) == []


def test_scope_and_resource_absence(run):
    metric = {"name": "g", "gauge": {"dataPoints": [{"asDouble": 1}]}}
    no_scope, no_version, unnamed = run(
        request(metric, scope=False, attributes=False),
        request(metric, version=""),
        {"resourceMetrics": [{"scopeMetrics": [{"scope": {}, "metrics": [metric]}]}]},
    )
    assert (no_scope["scope_name"], no_scope["resource_attrs"]) == (None, None)
    assert (no_version["scope_name"], no_version["scope_version"]) == ("test-scope", None)
    assert (unnamed["scope_name"], unnamed["scope_version"]) == ("", None)


def test_unsigned_wraps(run):
    point = {"timeUnixNano": "18446744073709551615", "flags": 4294967295,
             "startTimeUnixNano": "0", "count": "9223372036854775808"}
    (row,) = run(request({"name": "h", "histogram": {"dataPoints": [point]}}))
    assert (row["timestamp_ns"], row["flags"]) == (-1, -1)
    assert (row["start_timestamp_ns"], row["hist_count"]) == (None, -(2**63))


def test_malformed_request_yields_nothing(spark, tmp_path):
    from metricloom.sources.otlp import read_otlp

    good = json.dumps(request({"name": "g", "gauge": {"dataPoints": [{"asDouble": 1}]}}))
    (tmp_path / "in.json").write_text(f"not json\n{good}\n")
    rows = flatten(read_otlp(spark, str(tmp_path))).collect()
    assert [r.metric_name for r in rows] == ["g"]


def test_request_order_is_kept(run):
    metrics = [{"name": f"m{i}", "gauge": {"dataPoints": [{"asInt": i}]}} for i in range(20)]
    assert [r["value_int"] for r in run(request(*metrics))] == list(range(20))


def test_plan_is_narrow(spark):
    df = spark.createDataFrame([("{}",)], "value string")
    plan = flatten(parse_otlp(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
