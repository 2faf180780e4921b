"""The point table, JSON lines, arrival ids and the ad-hoc query."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from metricloom.operators.flatten import flatten
from metricloom.schema import METRIC_SCHEMA, POINT_COLUMNS
from metricloom.sources import jsonl, points as tables, query as adhoc
from metricloom.sources.arrival import SPLIT_COLUMNS, arrival_ids, in_order
from metricloom.sources.otlp import read_otlp
from metricloom.sources.scratch import scratch_dir

S = 1_000_000_000
HISTOGRAM = {
    "metric_name": "h", "metric_type": "histogram", "timestamp_ns": S, "hist_count": 100,
    "hist_sum": 5000.0, "hist_min": 0.5, "hist_max": 99.0, "hist_bounds": "[1.0,5.0,10.0]",
    "hist_counts": "[20,50,25,5]", "aggregation_temporality": 2, "start_timestamp_ns": S // 2,
}


def gauge(name="cpu.usage", ts=S, value=45.0, **more):
    return {"metric_name": name, "timestamp_ns": ts, "value_double": value,
            "resource_attrs": '{"service.name":"test"}', "scope_name": "test-scope", **more}


def test_append_and_scan(spark, make_points, tmp_path):
    path = str(tmp_path / "t")
    tables.append_points(make_points([gauge(), HISTOGRAM]), path)
    rows = tables.read_points(spark, path).orderBy("id").collect()
    assert [r.asDict() for r in rows] == [
        r.asDict() for r in make_points([gauge(), HISTOGRAM]).collect()
    ]


def test_append_numbers_rows_after_those_present(spark, make_points, tmp_path):
    path = str(tmp_path / "t")
    tables.append_points(make_points([]).drop("id"), path)
    assert tables.read_points(spark, path).count() == 0
    for batch in range(5):
        rows = make_points([gauge(ts=batch * 100 + i) for i in range(100)])
        tables.append_points(in_order(rows, "timestamp_ns").drop("id"), path)
    got = tables.read_points(spark, path).orderBy("timestamp_ns").select("id").collect()
    assert [r.id for r in got] == list(range(1, 501))


def write_requests(path, names):
    metrics = [{"name": n, "gauge": {"dataPoints": [{"asInt": 1}, {"asInt": 2}]}} for n in names]
    with open(path, "w") as f:
        for m in metrics:
            f.write(json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [m]}]}]}) + "\n")


def test_arrival_order_is_file_time_then_position(spark, tmp_path):
    # The later file is the larger one, which Spark schedules first.
    write_requests(tmp_path / "z.json", ["first", "second"])
    write_requests(tmp_path / "a.json", [f"n{i:03d}" for i in range(300)])
    os.utime(tmp_path / "z.json", (1000, 1000))
    os.utime(tmp_path / "a.json", (2000, 2000))
    points = flatten(read_otlp(spark, str(tmp_path)), keep=SPLIT_COLUMNS)
    with arrival_ids(points, base=10) as (numbered, rows):
        assert rows == 604
        got = numbered.orderBy("id").select("id", "metric_name", "value_int").collect()
    assert [r.id for r in got] == list(range(11, 615))
    names = [r.metric_name for r in got]
    assert names == sorted(names[:4]) + sorted(names[4:])
    assert [(r.metric_name, r.value_int) for r in got[:4]] == [
        ("first", 1), ("first", 2), ("second", 1), ("second", 2),
    ]


def test_analysis_layout(spark, make_points, tmp_path):
    path = str(tmp_path / "t")
    rows = [gauge(ts=i * S, name=f"m{i % 3}") for i in range(50)] + [HISTOGRAM]
    tables.write_analysis_layout(make_points(rows), path, files=4)
    tables.write_analysis_layout(make_points(rows), path, files=4)
    assert sorted(d for d in os.listdir(path) if "=" in d) == [
        "metric_type=gauge", "metric_type=histogram",
    ]
    points = tables.read_points(spark, path)
    assert points.columns == METRIC_SCHEMA.fieldNames() and points.count() == 51
    plan = points.where("metric_type = 'gauge' AND metric_name = 'm1'")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metric_type" in text
    assert "EqualTo(metric_name,m1)" in text


def test_layout_splits_a_hot_name(spark, make_points, tmp_path):
    path = str(tmp_path / "t")
    tables.write_analysis_layout(make_points([gauge()] * 400), path, files=4)
    sizes = [r["count"] for r in spark.read.parquet(path)
             .groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 250


def test_layout_files_do_not_grow_with_the_table(spark, make_points, tmp_path):
    for n in (100, 200):
        path = str(tmp_path / str(n))
        rows = [gauge(ts=(n - i) * S, name=f"m{i % 3}") for i in range(n)]
        tables.write_analysis_layout(make_points(rows), path, files=1, rows_per_file=20)
        held = (
            spark.read.parquet(path).groupBy(F.input_file_name())
            .agg(F.count("*").alias("rows"), F.min(F.struct("metric_name", "timestamp_ns")).alias("low"),
                 F.max(F.struct("metric_name", "timestamp_ns")).alias("high"))
            .orderBy("low").collect()
        )
        assert [r.rows for r in held] == [20] * (n // 20)
        assert all(a.high < b.low for a, b in zip(held, held[1:], strict=False))


def test_jsonl(spark, make_points, tmp_path):
    path = str(tmp_path / "j")
    jsonl.write_jsonl(make_points([gauge(dp_attrs='{"host":"node-1"}')]), path)
    jsonl.write_jsonl(make_points([HISTOGRAM, gauge(value=math.nan), gauge(value=math.inf)]), path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert len(lines) == 4
    for line in lines:
        assert list(line) == POINT_COLUMNS
    by_sum = {line["hist_sum"]: line for line in lines}
    assert by_sum[5000.0]["hist_counts"] == "[20,50,25,5]" and by_sum[5000.0]["value_double"] is None
    assert sorted(str(line["value_double"]) for line in lines) == ["45.0", "None", "None", "None"]
    back = jsonl.read_jsonl(spark, path).where("metric_type = 'histogram'").first()
    assert {k: v for k, v in back.asDict().items() if v is not None} == {**HISTOGRAM, "flags": 0}


@pytest.fixture
def table(spark, make_points, tmp_path):
    path = str(tmp_path / "t")
    rows = [("cpu", S + 1, 42), ("cpu", S + 2, 43), ("cpu", S + 3, 44), ("mem", 2 * S + 1, 70)]
    points = make_points(
        [gauge(n, t, None, value_int=v, dp_attrs='{"port":"Ethernet16"}') for n, t, v in rows]
    )
    tables.append_points(points, path)
    return tables.register_points(spark, path)


def values(df, column):
    return [json.loads(r.row)[column] for r in adhoc.rows_as_json(df).collect()]


def test_query_count(spark, table):
    result = adhoc.query(spark, "SELECT COUNT(*) as cnt FROM metric_data_points", 100)
    assert result.columns == ["cnt"] and values(result, "cnt") == [4]


def test_query_nanoseconds(spark, table):
    sql = ("select timestamp_ns FROM metric_data_points WHERE metric_name = 'cpu'"
           " ORDER BY timestamp_ns")
    assert values(adhoc.query(spark, sql), "timestamp_ns") == [S + 1, S + 2, S + 3]


@pytest.mark.parametrize(
    "sql",
    ["DROP TABLE metric_data_points", "INSERT INTO metric_data_points VALUES (1)",
     "DELETE FROM metric_data_points", "", "  ", "SHOW TABLES", "-- x\nSELECT 1",
     "WITH a AS (SELECT 1) INSERT INTO metric_data_points SELECT * FROM a",
     "SELECT 1; DROP VIEW metric_data_points", "SELECT 1) t; SELECT (2"],
)
def test_query_refuses(spark, table, sql):
    with pytest.raises(Exception):
        adhoc.query(spark, sql).collect()
    assert spark.catalog.tableExists("metric_data_points")


def test_query_limit_with_and_order(spark, table):
    assert adhoc.query(spark, "SELECT * FROM metric_data_points", 2).count() == 2
    sql = "WITH p AS (SELECT * FROM metric_data_points) SELECT value_int FROM p ORDER BY 1 DESC;"
    assert values(adhoc.query(spark, sql, 2), "value_int") == [70, 44]


def test_query_like_and_group(spark, table):
    sql = "SELECT value_int FROM metric_data_points WHERE dp_attrs LIKE '%Ethernet16%'"
    assert adhoc.query(spark, sql).count() == 4
    sql = ("SELECT DISTINCT metric_name, COUNT(*) as cnt FROM metric_data_points"
           " GROUP BY metric_name ORDER BY cnt DESC")
    assert values(adhoc.query(spark, sql), "cnt") == [3, 1]


def test_row_values(spark):
    df = spark.sql(
        "SELECT 2.0D AS whole, 2.5D AS frac, -0.0D AS zero, 1e300D AS big, double('NaN') AS nan,"
        " true AS t, CAST(NULL AS STRING) AS n, X'00ff' AS blob, 'q\"' AS s,"
        " 9007199254740993L AS exact, 1.50BD AS dec, 1 AS dup, 2 AS dup, DATE'2024-01-02' AS d"
    )
    text = adhoc.rows_as_json(df).first().row
    assert text == (
        '{"big":1e300,"blob":null,"d":"2024-01-02","dec":1.50,"dup":2,"exact":9007199254740993,'
        '"frac":2.5,"n":null,"nan":null,"s":"q\\"","t":1,"whole":2,"zero":0}'
    )


def test_scratch_is_under_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    a, b = scratch_dir(spark), scratch_dir(spark)
    assert a != b and a.startswith(shared)
