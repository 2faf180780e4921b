"""Ingest to several sinks and live series state."""

import json
import logging
import os

import pytest
from pyspark.sql import functions as F

from metricloom.operators import series
from metricloom.schema import METRIC_SCHEMA
from metricloom.sources import jsonl, points as tables
from metricloom.sources.otlp import read_otlp
from metricloom.streaming.history import read_history, run_history
from metricloom.streaming.ingest import BATCH_ID_BITS, CapReached, Ingest, read_series, run_ingest
from metricloom.streaming.latest import read_latest, run_latest
from metricloom.streaming.rate import IngestRateLog, ingest_rate

S = 1_000_000_000


def write_request(folder, name, values, mtime):
    points = [
        {"timeUnixNano": str(S + i), "asInt": str(v),
         "attributes": [{"key": "host", "value": {"stringValue": f"h{v % 2}"}}]}
        for i, v in enumerate(values)
    ]
    metric = {"name": "reqs", "sum": {"dataPoints": points, "isMonotonic": True}}
    request = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [metric]}]}]}
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(json.dumps(request) + "\n")
    os.utime(path, (mtime, mtime))


@pytest.fixture
def incoming(tmp_path):
    folder = str(tmp_path / "in")
    os.mkdir(folder)
    for i in range(4):
        write_request(folder, f"{9 - i}.json", range(i * 10, i * 10 + 10), 1000 + i)
    return folder


def requests(spark, folder):
    return read_otlp(spark, folder, streaming=True, maxFilesPerTrigger=1)


def sinks(tmp_path, tag=""):
    return {k: str(tmp_path / f"{tag}{k}") for k in ("table", "jsonl", "series")}


def test_ingest_fans_out(spark, incoming, tmp_path):
    paths = sinks(tmp_path)
    seen = []
    query = run_ingest(
        requests(spark, incoming), str(tmp_path / "cp"), available_now=True,
        on_batch=lambda df, batch_id: seen.append((batch_id, df.count())), **paths,
    )
    query.awaitTermination()
    table = tables.read_points(spark, paths["table"])
    rows = table.orderBy("id").collect()
    assert [r.value_int for r in rows] == list(range(40))
    assert [r.id for r in rows[::10]] == [(b << BATCH_ID_BITS) + 1 for b in range(4)]
    assert seen == [(b, 10) for b in range(4)]
    assert jsonl.read_jsonl(spark, paths["jsonl"]).count() == 40
    live = {(r.labels[0].v, r.value) for r in read_series(spark, paths["series"]).collect()}
    again = {(r.labels[0].v, r.value) for r in series.latest_per_series(table).collect()}
    assert live == again == {("h0", 38.0), ("h1", 39.0)}


def test_restart_continues_and_repeats_nothing(spark, incoming, tmp_path):
    paths, cp = sinks(tmp_path), str(tmp_path / "cp")
    for mtime in (None, 2000):
        if mtime:
            write_request(incoming, "new.json", [99], mtime)
        run_ingest(requests(spark, incoming), cp, available_now=True, **paths).awaitTermination()
    rows = tables.read_points(spark, paths["table"]).orderBy("id").collect()
    assert [r.value_int for r in rows] == [*range(40), 99]


def test_repeated_batch_replaces_itself(spark, make_points, tmp_path):
    paths = sinks(tmp_path)
    ingest = Ingest(str(tmp_path / "cp"), **paths)
    batch = make_points([{"metric_name": "m", "timestamp_ns": 1}] * 5).drop("id")
    for batch_id in (0, 1, 1):
        ingest.write(batch, batch_id)
    assert tables.read_points(spark, paths["table"]).count() == 10
    assert tables.read_points(spark, paths["table"]).select("id").distinct().count() == 10
    assert jsonl.read_jsonl(spark, paths["jsonl"]).count() == 10


def test_second_stream_gets_higher_ids(spark, incoming, tmp_path):
    paths = sinks(tmp_path)
    for cp in ("cp1", "cp2"):
        run_ingest(requests(spark, incoming), str(tmp_path / cp), available_now=True,
                   **paths).awaitTermination()
    table = tables.read_points(spark, paths["table"])
    assert table.count() == 80 and table.select("id").distinct().count() == 80
    last = table.orderBy(F.desc("id")).first()
    assert last.value_int == 39 and last.id >> BATCH_ID_BITS == 7


def test_row_cap_stops_at_a_batch_boundary(spark, incoming, tmp_path):
    paths = sinks(tmp_path)
    ingest = Ingest(str(tmp_path / "cp"), table=paths["table"], max_rows=15)
    query = ingest.run(requests(spark, incoming), processing_time="0 seconds")
    ingest.wait(60)
    assert not query.isActive
    assert tables.read_points(spark, paths["table"]).count() == 20
    # A batch past the cap fails, so nothing unwritten is committed, and a restart finds all rows.
    with pytest.raises(CapReached):
        ingest.write(spark.range(1), 99)
    again = Ingest(str(tmp_path / "cp"), table=paths["table"])
    again.run(requests(spark, incoming), available_now=True).awaitTermination()
    assert tables.read_points(spark, paths["table"]).count() == 40


def test_jsonl_failure_does_not_fail_the_batch(spark, make_points, tmp_path, caplog):
    blocked = tmp_path / "file"
    blocked.write_text("")
    ingest = Ingest(str(tmp_path / "cp"), table=str(tmp_path / "t"), jsonl=str(blocked))
    with caplog.at_level(logging.ERROR):
        ingest.write(make_points([{"metric_name": "m", "timestamp_ns": 1}]), 0)
    assert "not written" in caplog.text
    assert tables.read_points(spark, str(tmp_path / "t")).count() == 1


def test_table_failure_fails_the_batch(spark, make_points, tmp_path):
    blocked = tmp_path / "file"
    blocked.write_text("")
    ingest = Ingest(str(tmp_path / "cp"), table=str(blocked))
    with pytest.raises(Exception):
        ingest.write(make_points([{"metric_name": "m", "timestamp_ns": 1}]), 0)
    assert ingest.total == 0


def test_empty_batch(spark, make_points, tmp_path):
    ingest = Ingest(str(tmp_path / "cp"), table=str(tmp_path / "t"))
    ingest.write(make_points([]), 0)
    assert not os.path.exists(tmp_path / "t")


def point_stream(spark, points, path, files=3):
    ordered = points.repartitionByRange(files, "id").sortWithinPartitions("id")
    ordered.write.parquet(path)
    reader = spark.readStream.schema(METRIC_SCHEMA).option("maxFilesPerTrigger", 1)
    return reader.parquet(path)


def test_stream_latest_equals_batch(spark, make_points, tmp_path):
    rows = [
        {"metric_name": f"m{i % 3}", "timestamp_ns": (i * 7 % 50) * S, "value_double": float(i),
         "dp_attrs": f'{{"h":"{i % 2}"}}', "metric_type": ("sum", "gauge")[i % 5 > 0]}
        for i in range(60)
    ]
    points = make_points(rows)
    stream = point_stream(spark, points, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    run_latest(stream, out, str(tmp_path / "cp"), available_now=True).awaitTermination()

    def key(r):
        return r.series_name, r.labels[0].v, r.timestamp, r.value, r.metric_type, r.last_id

    live = sorted(map(key, read_latest(spark, out).collect()))
    assert live == sorted(map(key, series.latest_per_series(points).collect()))


def test_streams_share_a_path_for_latest(spark, make_points, tmp_path):
    points = make_points(
        [{"metric_name": f"m{i % 3}", "timestamp_ns": i * S, "value_double": float(i)} for i in range(8)]
    )
    out = str(tmp_path / "out")
    for tag, part in (("a", points.where("id <= 5")), ("b", points.where("id > 5"))):
        stream = point_stream(spark, part, str(tmp_path / tag), files=1)
        run_latest(stream, out, str(tmp_path / f"cp-{tag}"), available_now=True).awaitTermination()
    columns = ["series_name", "value", "first_id", "last_id"]
    live = sorted(map(tuple, read_latest(spark, out).select(columns).collect()))
    assert live == sorted(map(tuple, series.latest_per_series(points).select(columns).collect()))


def test_stream_rate(spark, make_points, tmp_path):
    points = make_points(
        [{"metric_name": "m", "timestamp_ns": t * S} for t in (0, 1, 4, 5, 11, 12, 13, 14)]
    )
    stream = point_stream(spark, points, str(tmp_path / "in"))
    at = F.expr("timestamp_micros(timestamp_ns div 1000)")
    rates = ingest_rate(stream.withColumn("at", at), "at", late="1 hour")
    query = (
        rates.writeStream.format("memory").queryName("rates").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = [(r.rows, r.rows_per_second) for r in spark.table("rates").orderBy("window_start").collect()]
    assert got == [(3, 0.6), (1, 0.2), (4, 0.8)]


def test_rate_log():
    now = [0.0]
    rate = IngestRateLog(interval=5.0, clock=lambda: now[0])
    for second, rows in [(0, 0), (3, 100), (6, 100), (9, 300), (15, 0), (20, 50)]:
        now[0] = float(second)
        rate.add(rows)
    # Silent until 5 s after the first data, and when nothing is new.
    assert rate.reports == [(500, 500 / 6), (50, 50 / 11)]


@pytest.mark.parametrize("chunk, how", [(3, {"retention": 12.0, "arrival": "arrived"}), (512, {"cutoff": 31.0})])
def test_state_of_a_stream_holds_the_history(spark, make_points, tmp_path, chunk, how):
    # Times go up with many late ones; the labels of a series come in two orders.
    rows = [
        {"metric_name": f"m{i % 3}", "timestamp_ns": (i - (i * 7 % 11)) * S, "value_double": float(i),
         "dp_attrs": ('{"a":"1","b":"2"}', '{"b":"2","a":"1"}', None)[i % 5 % 3],
         "metric_type": ("sum", "gauge")[i % 5 > 0]}
        for i in range(60)
    ]
    points = make_points(rows)
    arrived = F.col("id").cast("double") + 1
    folder, cp, changes = str(tmp_path / "in"), str(tmp_path / "cp"), []
    columns = ["id", "series_name", F.to_json("labels").alias("labels"), "timestamp", "value", "metric_type"]
    # Three runs on one checkpoint: each starts from the state that the last one left.
    for upto in (20, 21, 60):
        last = points.where(F.col("id").between(len(changes) and changes[-1][0] + 1, upto))
        last.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(METRIC_SCHEMA).parquet(folder).withColumn("arrived", arrived)
        seen = []
        run_history(
            stream, cp, chunk=chunk, available_now=True, **how,
            on_batch=lambda df, batch_id, seen=seen: seen.extend(df.collect()),
        ).awaitTermination()
        changes.append((upto, seen))
        sofar = points.where(F.col("id") <= upto).withColumn("arrived", arrived)
        want = sorted(map(tuple, series.series_history(sofar, **how).select(columns).collect()))
        assert sorted(map(tuple, read_history(spark, cp).select(columns).collect())) == want
    assert len(want) < 60
    everything = [r for _, seen in changes for r in seen]
    assert sum(r.evicted for r in everything) == 60 - len(want)
    newest = {(r.series_name, r.label_text): r.kept for r in everything}
    assert sum(newest.values()) == len(want)
    assert read_history(spark, cp, batch_id=0).count() == len(
        series.series_history(points.where("id <= 20").withColumn("arrived", arrived), **how).collect()
    )


def test_history_processor_loads_where_the_package_is_not_importable(tmp_path):
    """Spark runs the processor's ``init`` in a driver-side Python process without the package's path."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from metricloom.streaming.history import RetainedSeries

    blob = cloudpickle.dumps(RetainedSeries(None, 5.0, chunk=3))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import pickle, sys; p = pickle.loads(sys.stdin.buffer.read()); print(p.cutoff, p.chunk)"
    done = subprocess.run([sys.executable, "-c", code], input=blob, cwd=tmp_path, env=env, capture_output=True)
    assert done.returncode == 0, done.stderr.decode()[-500:]
    assert done.stdout.decode().split() == ["5.0", "3"]


def test_history_runs_on_a_session_with_the_default_state_store(spark, make_points, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    make_points([{"metric_name": "m", "timestamp_ns": i * S, "value_int": i} for i in range(6)]).write.parquet(
        str(tmp_path / "in")
    )
    spark.conf.set(key, default)
    try:
        stream = spark.readStream.schema(METRIC_SCHEMA).parquet(str(tmp_path / "in"))
        run_history(stream, str(tmp_path / "cp"), cutoff=2.0, available_now=True).awaitTermination()
        assert spark.conf.get(key) == default
    finally:
        spark.conf.set(key, before)
    assert sorted(r.value for r in read_history(spark, str(tmp_path / "cp")).collect()) == [2.0, 3.0, 4.0, 5.0]
