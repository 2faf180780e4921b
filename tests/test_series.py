"""Series store semantics: selection, latest, history, text output."""

import json
import random
from collections import defaultdict, deque
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from metricloom.operators import series
from metricloom.operators.samples import to_samples

S = 1_000_000_000


def gauge(name, value, attrs=None, ts=S, **more):
    return {"metric_name": name, "value_double": value, "dp_attrs": attrs, "timestamp_ns": ts, **more}


def counter(name, value, attrs=None, **more):
    return {"metric_name": name, "metric_type": "sum", "value_int": value, "dp_attrs": attrs,
            "timestamp_ns": S, "is_monotonic": True, "aggregation_temporality": 2, **more}


def histogram(name, count, total, attrs=None):
    return {"metric_name": name, "metric_type": "histogram", "hist_count": count,
            "hist_sum": total, "dp_attrs": attrs, "timestamp_ns": S}


@pytest.fixture(scope="module")
def text(make_points):
    return lambda *rows: [r.line for r in series.exposition(make_points(rows)).collect()]


def test_empty_store(text):
    assert text() == []


def test_gauge_without_labels(text):
    assert text(gauge("cpu.usage", 72.5)) == ["# TYPE cpu_usage gauge", "cpu_usage 72.5"]


def test_gauge_with_labels(text):
    lines = text(gauge("cpu.usage", 45.0, '{"host":"node-1","core":"0"}'))
    assert lines == ["# TYPE cpu_usage gauge", 'cpu_usage{core="0",host="node-1"} 45']


def test_counter_even_when_not_monotonic(text):
    lines = text(counter("http.requests", 42, '{"method":"GET"}', is_monotonic=False))
    assert lines == ["# TYPE http_requests counter", 'http_requests{method="GET"} 42']


def test_histogram_becomes_sum_and_count(text):
    assert text(histogram("req.duration", 100, 5000.0, '{"endpoint":"/api"}')) == [
        "# TYPE req_duration_count gauge", 'req_duration_count{endpoint="/api"} 100',
        "# TYPE req_duration_sum gauge", 'req_duration_sum{endpoint="/api"} 5000',
    ]


def test_latest_overwrites(text):
    assert text(gauge("temp", 10.0), gauge("temp", 20.0)) == ["# TYPE temp gauge", "temp 20"]


def test_several_series(text):
    lines = text(gauge("cpu", 50.0, '{"host":"a"}'), gauge("cpu", 70.0, '{"host":"b"}'),
                 counter("reqs", 100))
    assert lines == ["# TYPE cpu gauge", 'cpu{host="a"} 50', 'cpu{host="b"} 70',
                     "# TYPE reqs counter", "reqs 100"]


def test_names_that_sanitise_alike_stay_apart(text):
    assert text(gauge("a-b", 1.0), gauge("a.b", 2.0)) == [
        "# TYPE a_b gauge", "a_b 1", "# TYPE a_b gauge", "a_b 2",
    ]


def test_type_line_follows_first_arrival(text):
    lines = text(gauge("m", 1.0, '{"l":"z"}'), counter("m", 2, '{"l":"a"}'))
    assert lines == ["# TYPE m gauge", 'm{l="a"} 2', 'm{l="z"} 1']


def test_latest_is_by_arrival_not_time(make_points):
    points = make_points([gauge("t", 1.0, ts=9 * S), counter("t", 2), gauge("t", 3.0, ts=5 * S)])
    row = series.latest_per_series(points).first()
    assert (row.timestamp, row.value, row.metric_type) == (5.0, 3.0, "gauge")
    assert (row.first_id, row.last_id) == (1, 3)


def test_texts_with_equal_labels_are_one_series(make_points):
    points = make_points(
        [gauge("t", 1.0, '{"a":"1","b":"2"}'), gauge("t", 2.0, '{"b": "2", "a": "1"}'),
         gauge("u", 3.0, None), gauge("u", 4.0, "not json"), gauge("u", 5.0, "{}")]
    )
    got = {r.series_name: r.value for r in series.latest_per_series(points).collect()}
    assert got == {"t": 2.0, "u": 5.0}


def test_samples(make_points):
    rows = [
        gauge("g", None), histogram("h", None, 2.5), histogram("i", 3, None),
        {"metric_name": "e", "metric_type": "exp_histogram", "hist_sum": 9.0, "timestamp_ns": S},
        gauge("both", 1.5, value_int=7, ts=1_500_000_000),
    ]
    got = [(r.id, r.series_name, r.timestamp, r.value)
           for r in to_samples(make_points(rows)).orderBy("id").collect()]
    assert got == [(1, "g", 1.0, 0.0), (2, "h_sum", 1.0, 2.5), (3, "i_count", 1.0, 3.0),
                   (4, "e", 1.0, 0.0), (5, "both", 1.5, 1.5)]


def test_names_and_labels(make_points):
    points = make_points([gauge("a.b", 1.0, '{"x.y":1}'), gauge("a-b", 1.0), histogram("h", 1, 1.0)])
    assert [r.name for r in series.metric_names(points).collect()] == ["a_b", "h_count", "h_sum"]
    assert [r.label for r in series.label_names(points).collect()] == ["__name__", "x_y"]
    assert [r.label for r in series.label_names(make_points([])).collect()] == ["__name__"]


@pytest.fixture(scope="module")
def cpus(make_points):
    return make_points([gauge("cpu", 50.0, '{"host":"a"}'), gauge("cpu", 70.0, '{"host":"b"}'),
                        gauge("cpu.x", 1.0, '{"host":"a"}')])


def test_instant_with_filter(cpus):
    (row,) = series.instant(cpus, "cpu", {"host": "a"}).collect()
    assert json.loads(row.metric) == {"__name__": "cpu", "host": "a"}
    assert json.loads(row.point) == [1.0, "50"]
    (result,) = series.envelope(series.instant(cpus, "cpu", {"host": "a"}), "vector").collect()
    assert (result.status, result.resultType) == ("success", "vector")
    assert json.loads(result.result)["value"][1] == "50"


@pytest.mark.parametrize(
    "name, labels, count",
    [(None, {}, 3), ("", {"host": "a"}, 2), ("cpu.x", {}, 1), ("cpu_x", {}, 1), ("cpu-x", {}, 1),
     ("cpu", {"host": "c"}, 0), ("nope", {}, 0), ("cpu", {"host": "a", "other": "1"}, 0)],
)
def test_selection(cpus, name, labels, count):
    assert series.instant(cpus, name, labels).count() == count


@pytest.mark.parametrize(
    "raw", ["a.b", "a_b", "a-b", "a\nb", "aéb", "a😀b", "axb", "a:b", "a1b", "a.b\n", "xa.b", "a..b"]
)
def test_selection_compares_sanitised_names(make_points, raw):
    clean = "".join(c if c.isascii() and (c.isalnum() or c in "_:") else "_" for c in raw)
    points = make_points([gauge(raw, 1.0)])
    assert series.instant(points, "a_b").count() == (clean == "a_b")


def test_selecting_histogram_parts(make_points):
    points = make_points([histogram("req.duration", 2, 3.0), gauge("req-duration_sum", 9.0)])
    assert series.instant(points, "req_duration_count").count() == 1
    assert series.instant(points, "req_duration_sum").count() == 2


def test_range_without_history_is_latest(make_points):
    points = make_points([gauge("t", v, ts=int(v) * S) for v in (10.0, 20.0, 30.0)])
    (row,) = series.range_(points, "t", start=0, end=1).collect()
    assert row.value == 30.0


def test_range_with_history(make_points):
    points = make_points([gauge("t", v, ts=int(v) * S) for v in (10.0, 20.0, 30.0)])
    kept = series.range_(points, "t", start=10, end=20, retention=timedelta(hours=1), as_of=40.0)
    assert sorted(r.value for r in kept.collect()) == [10.0, 20.0]
    element = series.envelope(kept, "matrix").first()
    assert json.loads(element.result)["metric"] == {"__name__": "t"}


def test_matrix_chunks(make_points, monkeypatch):
    monkeypatch.setattr(series, "_BLOCK_BITS", 2)
    monkeypatch.setattr(series, "_STRETCH_BITS", 1)
    rows = [gauge("t", float(i), '{"h":"%s"}' % ("hot" if i % 3 else "cold"), ts=i * S) for i in range(60)]
    kept = series.range_(make_points(rows), "t", start=0, end=100, cutoff=0.0)
    found = {}
    for row in series.matrix(kept, samples=7).collect():
        element = json.loads(row.result)
        found[element["metric"]["h"], row.chunk] = [float(v) for _, v in element["values"]]
    for host, values in {
        "hot": [float(i) for i in range(60) if i % 3], "cold": [float(i) for i in range(60) if not i % 3]
    }.items():
        chunks = {c: v for (h, c), v in found.items() if h == host}
        assert [v for c in sorted(chunks) for v in chunks[c]] == values
        assert sorted(chunks) == list(range(-(-len(values) // 7)))
        assert all(len(chunks[c]) == 7 for c in sorted(chunks)[:-1])
    assert series.matrix(kept.where("id < 0")).count() == 0


def test_evicted_series_has_no_value(make_points):
    rows = [
        gauge("t", 1.0, '{"h":"old"}', ts=10 * S), gauge("t", 2.0, '{"h":"new"}', ts=50 * S),
        gauge("gone", 3.0, ts=20 * S), gauge("t", 4.0, '{"h":"new"}', ts=5 * S),
    ]
    points = make_points(rows)
    assert [r.value for r in series.instant(points, cutoff=50.0).collect()] == [4.0]
    assert series.instant(points, retention=5.0, as_of=60.0).count() == 0
    assert series.instant(points).count() == 3
    lines = [r.line for r in series.exposition(points, cutoff=50.0).collect()]
    assert lines == ["# TYPE gone gauge", "# TYPE t gauge", 't{h="new"} 4']
    late = points.withColumn("seen", F.expr("CASE WHEN metric_name = 't' THEN 60.0D ELSE 21.0D END"))
    kept = series.instant(late, retention=10.0, arrival="seen").collect()
    assert sorted(r.value for r in kept) == [3.0, 4.0]


def test_history_and_range_bounds_reach_the_scan(spark, make_points, tmp_path):
    make_points([gauge("t", v, ts=int(v) * S) for v in (10.0, 20.0, 30.0)]).write.parquet(
        str(tmp_path / "p")
    )
    stored = spark.read.parquet(str(tmp_path / "p"))
    found = series.range_(stored, "t", start=15.0, end=25.0, cutoff=5.0)
    plan = found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "GreaterThanOrEqual(timestamp_ns" in plan and "LessThanOrEqual(timestamp_ns" in plan
    assert [r.value for r in found.collect()] == [20.0]


@pytest.mark.parametrize("seconds", [0.0, -1.5, 1.7e9, 1_705_000_000.123456, 9.2e9])
def test_whole_bounds_hold_every_sample(seconds):
    for ns in range(int(seconds * 1e9) - 600, int(seconds * 1e9) + 600, 7):
        if ns / 1e9 >= seconds:
            assert ns >= series._nanos(seconds)
        if ns / 1e9 <= seconds:
            assert ns <= series._nanos(seconds, after=True)


def replay(rows, cutoff_of):
    """The store's eviction, sample by sample."""
    queues = defaultdict(deque)
    for i, row in enumerate(rows, 1):
        queue = queues[row["dp_attrs"]]
        queue.append((i, row["timestamp_ns"] / 1e9))
        while queue and queue[0][1] < cutoff_of(row):
            queue.popleft()
    return sorted(i for q in queues.values() for i, _ in q)


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def random_rows(seed):
    rng = random.Random(seed)
    return [
        gauge("t", float(i), f'{{"h":"{rng.randint(0, 3)}"}}', ts=rng.randint(0, 100) * S)
        for i in range(200)
    ]


@pytest.mark.parametrize("cutoff", [0.0, 50.0, 97.0, 200.0])
def test_history_matches_replay(make_points, cutoff):
    rows = random_rows(3)
    kept = series.series_history(make_points(rows), cutoff=cutoff)
    assert sorted(r.id for r in kept.collect()) == replay(rows, lambda r: cutoff)


def test_history_by_shuffled_join(make_points, no_broadcast):
    rows = random_rows(5)
    kept = series.series_history(make_points(rows), cutoff=60.0)
    assert "SortMergeJoin" in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in kept.collect()) == replay(rows, lambda r: 60.0)


def test_history_by_last_arrival_matches_replay(make_points, spark):
    rows = random_rows(4)
    for i, row in enumerate(rows):
        row["value_int"] = i  # arrival second
    points = make_points(rows).withColumnRenamed("hist_sum", "seen").drop("seen")
    points = points.selectExpr("*", "CAST(value_int AS DOUBLE) AS seen", "hist_min AS hist_sum")
    kept = series.series_history(points, retention=120.0, arrival="seen")
    expected = replay(rows, lambda r: r["value_int"] - 120.0)
    assert sorted(r.id for r in kept.collect()) == expected


def test_late_sample_survives_behind_a_newer_one(make_points):
    points = make_points([gauge("t", 1.0, ts=S), gauge("t", 2.0, ts=90 * S), gauge("t", 3.0, ts=2 * S)])
    kept = series.series_history(points, retention=60, as_of=100.0)
    assert sorted(r.value for r in kept.collect()) == [2.0, 3.0]


def test_history_keeps_texts_of_a_fresh_series(make_points):
    points = make_points([gauge("t", 1.0, '{"a":1}', ts=90 * S), gauge("t", 2.0, '{"a": 1}', ts=S)])
    assert series.series_history(points, cutoff=50.0).count() == 2


def test_history_needs_a_limit(make_points):
    with pytest.raises(ValueError):
        series.series_history(make_points([]))
