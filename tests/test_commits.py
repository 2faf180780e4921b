"""Committed batches, bad requests set apart, units and rates of an ingest."""

import json

import pytest
from pyspark.sql import functions as F

from metricloom.operators import extracts, series
from metricloom.operators.flatten import flatten
from metricloom.sources import arrival
from metricloom.sources import points as tables
from metricloom.sources.commits import CommitConflict, CommitLog, DataFile, first_files
from metricloom.sources.otlp import BAD_NUMBER, NOT_A_REQUEST, accepted, read_otlp, rejected
from metricloom.streaming.ingest import Ingest, read_series, run_ingest
from metricloom.streaming.latest import read_latest, run_latest
from metricloom.streaming.rate import IngestRateLog

S = 1_000_000_000


def some_points(make_points, n, start=0):
    return make_points([{"metric_name": f"m{i % 3}", "timestamp_ns": i, "value_double": float(i)} for i in range(start, start + n)])


def test_a_batch_killed_half_way_is_not_seen(spark, make_points, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    ingest = Ingest(str(tmp_path / "cp"), table=path)
    ingest.write(some_points(make_points, 5).drop("id"), 0)

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        # All data files of the batch are there, its commit is not.
        patch.setattr(CommitLog, "commit", killed)
        with pytest.raises(RuntimeError):
            ingest.write(some_points(make_points, 7, 5).drop("id"), 1)
    assert tables.read_points(spark, path).count() == 5
    assert tables.max_id(spark, path) == 5
    # A reader that planned before the retry keeps its files, too.
    before = tables.read_points(spark, path)
    ingest.write(some_points(make_points, 7, 5).drop("id"), 1)
    assert (before.count(), tables.read_points(spark, path).count()) == (5, 12)


def test_commits_are_compacted_and_conflicts_refused(spark, make_points, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"))
    files = log.write(some_points(make_points, 2), "a", 0)
    for batch in range(23):
        log.commit(files, "a", batch % 4)
    assert len(log.manifests()) == 4 and log.last_version() == 23
    assert [(c.batch_id, c.version) for c in log.commits()] == [(3, 20), (0, 21), (1, 22), (2, 23)]
    with pytest.raises(CommitConflict):
        log.files.publish(f"{log.folder}/{23:020d}.json", "")


def test_ids_are_dense_where_rows_were_left_out(spark, make_points, monkeypatch):
    points = some_points(make_points, 300).drop("id").repartitionByRange(3, "timestamp_ns").sortWithinPartitions("timestamp_ns")
    monkeypatch.setattr(arrival, "RANKED", 16)
    for keep, n in (("true", 300), ("timestamp_ns % 7 <> 3", 257), ("timestamp_ns > 150", 149)):
        with arrival.staged(points) as kept:
            found = arrival.numbered(kept.where(keep), 1000).orderBy("timestamp_ns")
            assert found.columns == [*points.columns, "id"]
            assert [r["id"] for r in found.select("id").collect()] == list(range(1001, 1001 + n))


def test_batch_replaced_by_an_empty_one(spark, make_points, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"))
    log.append(some_points(make_points, 3), "a", 0)
    log.append(some_points(make_points, 0), "a", 0)
    assert tables.read_points(spark, log.path).count() == 0


def test_first_files_of_overlapping_ranges():
    def file(name, rows, least, most):
        return DataFile(name, 1, rows, least, most, None)

    files = [file("a", 5, 1, 9), file("b", 5, 2, 30), file("c", 5, 10, 14), file("d", 5, 31, 35)]
    assert [f.file for f in first_files(files, 3)] == ["a", "b"]
    assert [f.file for f in first_files(files, 10)] == ["a", "b", "c"]
    assert [f.file for f in first_files(files, 99)] == ["a", "b", "c", "d"]
    assert [f.file for f in first_files(files, 5, latest=True)] == ["d"]
    assert [f.file for f in first_files(files, 6, latest=True)] == ["b", "c", "d"]


def test_head_and_tail_read_few_files(spark, make_points, tmp_path):
    path = str(tmp_path / "t")
    for i in range(4):
        tables.append_points(some_points(make_points, 10, 10 * i).drop("id").coalesce(1), path)
    every = tables.read_points(spark, path)
    for n in (1, 10, 11, 35, 99):
        head, tail = tables.read_points(spark, path, first=n), tables.read_points(spark, path, last=n)
        assert len(head.inputFiles()) == len(tail.inputFiles()) == min(4, -(-n // 10))
        assert extracts.head(head, n).collect() == extracts.head(every, n).collect()
        assert extracts.tail(tail, n).collect() == extracts.tail(every, n).collect()
        plan = extracts.tail(tail, n)._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan


def write_lines(path, lines):
    path.write_text("".join(line + "\n" for line in lines))


def request(points, **resource):
    metric = {"name": "reqs", "gauge": {"dataPoints": points}}
    return json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [metric]}], **resource}]})


GOOD = request([{"timeUnixNano": "7", "asInt": str(i)} for i in range(100)])
BAD = {
    "cut off": (GOOD[:-5], NOT_A_REQUEST),
    "no json": ("hello", NOT_A_REQUEST),
    "other type": ('{"resourceMetrics": "x"}', NOT_A_REQUEST),
    "time": (request([{"timeUnixNano": "yesterday"}, {"timeUnixNano": "1"}]), BAD_NUMBER),
    "value": (request([{"asInt": "1.5e"}]), BAD_NUMBER),
    "counts": (request([{"bucketCounts": ["1", "x", "3"]}]), BAD_NUMBER),
    "hole": (request([{"positive": {"bucketCounts": ["1", None]}}]), BAD_NUMBER),
    "attribute": (request([{"attributes": [{"key": "a", "value": {"intValue": "q"}}]}]), BAD_NUMBER),
    "resource": (request([], resource={"attributes": [{"key": "a", "value": {"intValue": "q"}}]}), BAD_NUMBER),
}


def test_bad_requests_are_set_apart(spark, tmp_path):
    write_lines(tmp_path / "in.json", [GOOD, *(line for line, _ in BAD.values()), "{}", GOOD])
    flat = flatten(read_otlp(spark, str(tmp_path)), rejects=True)
    assert accepted(flat).count() == 200
    got = rejected(flat).collect()
    assert sorted(r.reason for r in got) == sorted(reason for _, reason in BAD.values())
    lines = [r.line for r in got if r.reason == NOT_A_REQUEST]
    assert sorted(lines) == sorted(line for line, reason in BAD.values() if reason == NOT_A_REQUEST)
    assert any("yesterday" in r.line for r in got)


def test_bad_counts_keep_their_place(spark, tmp_path):
    metric = {"name": "h", "histogram": {"dataPoints": [{"bucketCounts": ["1", "x", "3"]}]}}
    write_lines(tmp_path / "in.json", [json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [metric]}]}]})])
    assert flatten(read_otlp(spark, str(tmp_path))).first().hist_counts == "[1,null,3]"





def test_ingest_of_requests_counts_points(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_lines(folder / "a.json", [GOOD, BAD["time"][0], GOOD, "hello"])
    rate = IngestRateLog(interval=1e-6)
    spark.streams.addListener(rate)
    try:
        query = run_ingest(
            read_otlp(spark, str(folder), streaming=True), str(tmp_path / "cp"), available_now=True,
            table=str(tmp_path / "t"), rejects=str(tmp_path / "r"), flush_points=70,
        )
        query.awaitTermination()
        told = [p.observedMetrics["metricloom_ingest"] for p in query.recentProgress if p.numInputRows]
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(rate)
    assert [(r.points, r.rejected) for r in told] == [(200, 2)]
    assert (rate.total, rate.rejected) == (200, 2)
    bad = CommitLog(spark, str(tmp_path / "r")).read("line string, reason string")
    assert sorted(r.reason for r in bad.collect()) == [NOT_A_REQUEST, BAD_NUMBER]
    # Units of 70 points and one rest.
    units = CommitLog(spark, str(tmp_path / "t")).units()
    assert [(batch, unit, rows) for _, batch, unit, rows in units] == [(0, 0, 70), (0, 1, 70), (0, 2, 60)]
    ids = tables.read_points(spark, str(tmp_path / "t")).agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()
    assert tuple(ids) == (1, 200, 200)


def test_a_batch_beyond_its_range_of_ids(spark, make_points, tmp_path, monkeypatch):
    monkeypatch.setattr("metricloom.streaming.ingest.BATCH_ID_BITS", 2)
    ingest = Ingest(str(tmp_path / "cp"), table=str(tmp_path / "t"))
    for batch in range(3):
        ingest.write(some_points(make_points, 10, 10 * batch).drop("id").coalesce(1), batch)
    rows = tables.read_points(spark, str(tmp_path / "t")).orderBy("id").collect()
    assert [r.value_double for r in rows] == [float(i) for i in range(30)]


def test_series_changes_are_folded(spark, make_points, tmp_path):
    ingest = Ingest(str(tmp_path / "cp"), series=str(tmp_path / "s"), fold_after=3)
    every = some_points(make_points, 40)
    for batch in range(8):
        own = every.where(F.col("id").between(5 * batch + 1, 5 * batch + 5))
        ingest.write(own, batch)
        # A batch repeated after it was folded changes nothing.
        ingest.write(own, batch)
        assert len(CommitLog(spark, str(tmp_path / "s")).commits()) <= 4
    columns = ["series_name", "value", "metric_type", "first_id", "last_id"]
    live = sorted(map(tuple, read_series(spark, str(tmp_path / "s")).select(columns).collect()))
    assert live == sorted(map(tuple, series.latest_per_series(every).select(columns).collect()))


def test_latest_reads_a_bounded_log(spark, make_points, tmp_path):
    every = some_points(make_points, 60)
    every.repartitionByRange(6, "id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    run_latest(stream, out, str(tmp_path / "cp"), fold_after=2, available_now=True).awaitTermination()
    log = CommitLog(spark, out)
    assert len(log.commits()) <= 3 and sum(c.rows for c in log.commits()) <= 3 * 3
    columns = ["series_name", "value", "metric_type", "first_id", "last_id"]
    live = sorted(map(tuple, read_latest(spark, out).select(columns).collect()))
    assert live == sorted(map(tuple, series.latest_per_series(every).select(columns).collect()))
