"""Bucket averages, series names, variable lists and extracts."""

import pytest
from pyspark.sql import functions as F

from metricloom.operators import buckets, catalog, extracts, filters, naming
from metricloom.plans.dimensions import sai_stats, sai_types, stat_rows

S = 1_000_000_000


def counter(ts, value, obj="Ethernet0", tid="1", sid="0"):
    attrs = f'{{"object_name":"{obj}","sai_type_id":"{tid}","sai_stat_id":"{sid}"}}'
    return {"metric_name": "c", "timestamp_ns": ts, "value_int": value, "dp_attrs": attrs}


def averages(points, **options):
    rows = buckets.bucket_avg(points, **options).orderBy("bucket", "obj", "tid", "sid").collect()
    return [(r.time, r.value) for r in rows]


def test_average_per_bucket(make_points):
    points = make_points([counter(i * S, i) for i in range(11)])
    assert averages(points, max_points=2) == [(0, 2.0), (5, 7.0), (10, 10.0)]


def test_sub_second_buckets_stay_apart(make_points):
    points = make_points([counter(S + i * S // 4, i) for i in range(4)])
    assert averages(points, max_points=0) == [(1, 0.0), (1, 1.0), (1, 2.0), (1, 3.0)]
    assert len(averages(points, max_points=3)) == 4


def test_raw_and_wide_buckets_agree_on_totals(make_points):
    points = make_points([counter(i * S, i, obj=f"E{i % 3}") for i in range(30)])
    assert len(averages(points, max_points=0)) == 30
    assert averages(points, max_points=1, start=0, end=29 * S)[0] == (0, 13.5)


def test_bounds(make_points):
    points = make_points([counter(i * S + S // 2, i) for i in range(10)])
    low = averages(points, max_points=0, start="1970-01-01 00:00:03")
    assert [v for _, v in low] == [3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]
    # The end is a whole second: the half second behind it is out.
    high = averages(points, max_points=0, end="1970-01-01 00:00:03")
    assert [v for _, v in high] == [0.0, 1.0, 2.0]
    assert len(averages(points, max_points=0, start="soon", end="")) == 10


def test_one_bound_and_width_from_the_other_extreme(make_points):
    points = make_points([counter(i * S, i) for i in range(10)])
    assert averages(points, max_points=3, start="1970-01-01 00:00:03") == [
        (2, 3.0), (4, 4.5), (6, 6.5), (8, 8.5),
    ]


def test_doubles_have_no_integer_average(make_points):
    points = make_points([{**counter(S, None), "value_double": 2.5}])
    assert averages(points, max_points=1) == [(1, None)]
    assert averages(points, max_points=0, value_col="value_double") == [(1, 2.5)]


@pytest.mark.parametrize("max_points", [0, 5])
def test_filters(make_points, max_points):
    points = make_points(
        [counter(S, 1, "Ethernet0"), counter(S, 2, "Ethernet04"), counter(S, 4, "E\\u0074hernet0"),
         counter(2 * S, 8, "Ethernet0", tid="21"), counter(2 * S, 16, "Ethernet0", sid="3")]
    )
    rows = buckets.bucket_avg(points, max_points, objects=["Ethernet0"], types=["1"], stats=["0"])
    assert [(r.obj, r.value) for r in rows.collect()] in (
        [("Ethernet0", 2.5)],
        [("Ethernet0", 2.5)],
    )


def test_empty_table(make_points):
    assert averages(make_points([]), max_points=10) == []


@pytest.mark.parametrize(
    "text, seconds",
    [("1970-01-02", 86400), ("1970-01-01 00:01", 60), ("1970-01-01T00:00:05.9", 5),
     ("1970-01-01 01:00:00+01:00", 0), ("1970-01-01 00:00:00Z", 0), ("2024-02-30", 1709251200),
     ("", None), ("garbage", None), ("2024-13-01", None), ("2024", None), ("1970-01-01 25:00", None)],
)
def test_date_text(text, seconds):
    assert buckets.epoch_seconds(text) == seconds


def test_series_names(spark, make_points):
    points = make_points(
        [counter(S, 1), counter(S, 1, tid="24", sid="0"), counter(S, 1, tid="26", sid="99"),
         counter(S, 1, tid="7", sid="5"), counter(S, 1, tid="21x", sid="1")]
    )
    out = naming.dashboard(buckets.bucket_avg(points, 1), sai_types(spark), sai_stats(spark))
    assert sorted(r.series for r in out.collect()) == [
        "Ethernet0_BufPool_CurrOccupancyBytes", "Ethernet0_IngressPG_stat99",
        "Ethernet0_Port_IfInOctets", "Ethernet0_Queue_Bytes", "Ethernet0_T7_stat5",
    ]


def test_wide(spark, make_points):
    points = make_points([counter(S, 1), counter(S, 3, sid="1"), counter(2 * S, 5)])
    long = naming.dashboard(buckets.bucket_avg(points, 0), sai_types(spark), sai_stats(spark))
    names = ["Ethernet0_Port_IfInOctets", "Ethernet0_Port_IfInUcastPkts"]
    rows = naming.wide(long, names).collect()
    assert [tuple(r) for r in rows] == [(1, 1.0, 3.0), (2, 5.0, None)]


def test_dimension_rows():
    rows = stat_rows()
    assert len(rows) == len({r[:2] for r in rows}) == 291
    sizes = {t: sum(r[0] == t for r in rows) for t in (1, 21, 24, 26)}
    assert sizes == {1: 204, 21: 47, 24: 25, 26: 15}
    names = {r[:2]: r[2] for r in rows}
    for key, name in {
        (1, 31): "EtherStatsPkts9217To16383Octets", (1, 67): "RedWredDroppedBytes",
        (1, 94): "InSharedWatermarkBytes", (1, 118): "Pfc7TxPkts",
        (1, 172): "Dot3ControlInUnknownOpcodes", (1, 182): "IfOutFabricDataUnits",
        (1, 199): "IfInFecCodewordErrorsS16", (21, 39): "DelayWatermarkNs",
        (24, 21): "XoffRoomCurrOccupancyCells", (26, 14): "XoffRoomWatermarkCells",
    }.items():
        assert names[key] == name


def test_variables(spark, make_points):
    points = make_points(
        [counter(S, 1, tid="26"), counter(S, 1, tid="1"), counter(S, 1, tid="9"),
         {"metric_name": "x", "timestamp_ns": S}, counter(S, 1, "Ethernet4", tid="21", sid="0")]
    )
    assert [r.text for r in catalog.var_objects(points).collect()] == [None, "Ethernet0", "Ethernet4"]
    assert [tuple(r) for r in catalog.var_types(points).collect()] == [
        (None, None), ("1", "Port"), ("9", "Type9"), ("21", "Queue"), ("26", "IngressPriorityGroup"),
    ]
    stats = [tuple(r) for r in catalog.var_stats(points, sai_stats(spark)).collect()]
    assert stats == [
        (None, None), ("0", "IfInOctets (0)"), ("0", "stat0 (0)"), ("0", "Packets (0)"),
        ("0", "Packets (0)"),
    ]


def test_catalogue(make_points):
    points = make_points([{"metric_name": n, "timestamp_ns": 1} for n in ("cpu", "cpu", "mem")])
    assert [tuple(r) for r in catalog.metric_catalogue(points).collect()] == [
        ("cpu", "gauge", 2), ("mem", "gauge", 1),
    ]
    assert [tuple(r) for r in catalog.count_by_metric(points).collect()] == [("cpu", 2), ("mem", 1)]
    assert catalog.count_points(points).first()[0] == 3
    assert [r[0] for r in catalog.metric_types(points).collect()] == ["gauge"]


def test_attr_like(make_points):
    texts = ['{"port":"Ethernet16"}', '{"port":"a\\\\b"}', None]
    points = make_points([{"metric_name": "m", "timestamp_ns": 1, "dp_attrs": t} for t in texts])
    assert filters.attr_like(points, "%ETHERNET16%").count() == 1
    assert filters.attr_like(points, "%\\%").count() == 1


def test_extracts(make_points):
    rows = [{"metric_name": "m", "timestamp_ns": t, "value_double": float(t), "value_int": t}
            for t in (3 * S, S, 2 * S + 500_000_000)]
    points = make_points(rows)
    assert [r.time for r in extracts.time_series(points, "m").collect()] == [1, 2, 3]
    assert [r.time for r in extracts.time_series_float(points, "m").collect()] == [1.0, 2.5, 3.0]
    assert extracts.time_series(points, "m", S, 2 * S).count() == 1
    assert extracts.first_point(points, "m").first().timestamp_ns == S
    assert [r.id for r in extracts.tail(points, 2).collect()] == [3, 2]
    assert [r.id for r in extracts.head(points, 2).collect()] == [1, 2]


@pytest.mark.parametrize("max_rows, batch, expected", [(0, 10, 100), (25, 10, 30), (30, 10, 30),
                                                       (1, 1, 1), (99, 7, 100), (500, 10, 100)])
def test_cap(make_points, max_rows, batch, expected):
    points = make_points([{"metric_name": "m", "timestamp_ns": 1}] * 100)
    kept = sorted(r.id for r in extracts.cap_rows(points, max_rows, batch).collect())
    assert kept == list(range(1, expected + 1))


@pytest.mark.parametrize("n", [1, 9, 10, 11, 57, 100, 150, 1000])
def test_large_head_and_tail_without_sorting(spark, monkeypatch, n):
    monkeypatch.setattr(extracts, "_BLOCK_BITS", 3)
    monkeypatch.setattr(extracts, "TOP_K", 0)
    ids = sorted({i * 3 + (i % 7) for i in range(150)})
    points = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(4)
    assert [r.id for r in extracts.head(points, n).collect()] == ids[:n]
    assert [r.id for r in extracts.tail(points, n).collect()] == ids[-n:][::-1]


@pytest.mark.parametrize("type_id, first, last", [
    (1, (0, "IfInOctets"), (203, "TxTrimPackets")),
    (21, (0, "Packets"), (46, "TxTrimPackets")),
    (24, (0, "CurrOccupancyBytes"), (24, "WatermarkCells")),
    (26, (0, "Packets"), (14, "XoffRoomWatermarkCells")),
])
def test_statistic_names(type_id, first, last):
    own = [r[1:] for r in stat_rows() if r[0] == type_id]
    assert (own[0], own[-1]) == (first, last) and [i for i, _ in own] == list(range(len(own)))


def test_histogram_arrays(make_points):
    points = make_points([{"metric_name": "h", "metric_type": "histogram", "timestamp_ns": S,
                           "hist_bounds": "[1.0,5.0]", "hist_counts": "[20,18446744073709551615,0]"}])
    row = extracts.histogram_arrays(extracts.histogram_rows(points, "h")).first()
    assert row.bounds == [1.0, 5.0] and int(row.counts[1]) == 2**64 - 1


def test_time_bounds_share_one_scan(make_points):
    points = make_points([counter(i * S, i) for i in range(3)])
    lo, hi = buckets.time_bounds(points)
    assert points.limit(1).select(lo.alias("a"), hi.alias("b")).first() == (0, 2 * S)
    assert points.where(F.col("timestamp_ns") == lo).count() == 1


@pytest.mark.parametrize(
    "value, testable",
    [("Ethernet0", True), ("node-1", True), ("true", True), ("1", False), ("-2", False),
     (" 3", False), ("", False), ("[1]", False), ('a"b', False), ("a\nb", False), ("a\\b", True)],
)
def test_which_values_can_be_tested_on_raw_text(spark, value, testable):
    assert (filters.mentions("dp_attrs", ["x", value]) is not None) == testable


def test_prefilter_keeps_escaped_spellings(make_points):
    texts = ['{"k":"a\\\\b"}', '{"k":"a\\u005cb"}', '{"k":"ab"}', None]
    points = make_points([{"metric_name": "m", "timestamp_ns": 1, "dp_attrs": t} for t in texts])
    assert filters.attr_in(points, "k", ["a\\b"]).count() == 2
