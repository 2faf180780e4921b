"""The physical plans the design relies on."""

import pytest
from pyspark.sql import functions as F

from metricloom.operators import buckets, catalog, extracts, naming, series
from metricloom.operators.samples import to_samples
from metricloom.plans.dimensions import sai_stats, sai_types
from metricloom.sources import points as tables


@pytest.fixture(scope="module")
def stored(spark, make_points, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "t")
    tables.append_points(make_points([{"metric_name": "m", "timestamp_ns": 1}] * 3), path)
    return tables.read_points(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_samples_are_narrow(stored):
    assert "Exchange" not in plan(to_samples(stored))


def test_latest_is_hash_aggregated(stored):
    text = plan(series.latest_per_series(stored))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    # Partial and final step per level: by text, then by labels.
    assert text.count("HashAggregate") == 4 and text.count("Exchange") == 2
    assert text.count("FileScan") == 1


def test_selection_reaches_the_scan(stored):
    text = plan(series.instant(stored, "app_view", {"host": "a"}))
    assert "StringStartsWith(metric_name,app)" in text


def test_labels_are_parsed_above_the_first_aggregation(stored):
    text = plan(series.instant(stored, "m", {"host": "a"}))
    assert "exists(labels" in text
    assert "from_json" not in text[text.rindex("HashAggregate(keys=[series_name"):]
    assert "StringContains(dp_attrs,a)" in text


def test_attributes_are_parsed_above_the_first_aggregation(stored):
    text = plan(buckets.bucket_avg(stored, 10, 0, 100, objects=["Ethernet0"], types=["1"]))
    assert "from_json" not in text[text.rindex("HashAggregate(keys=[bucket"):]
    assert "StringContains(dp_attrs,Ethernet0)" in text


def test_exposition_reads_the_points_once(stored):
    text = plan(series.exposition(stored))
    assert "dp_attrs" not in text


def test_history_has_no_window(stored):
    text = plan(series.series_history(stored, cutoff=1.0))
    assert "Window" not in text and "collect_list" not in text and "NestedLoop" not in text


def test_dashboard(stored, spark):
    averages = buckets.bucket_avg(stored, 10, start="2024-01-01", end="2024-01-02")
    text = plan(naming.dashboard(averages, sai_types(spark), sai_stats(spark)))
    assert "GreaterThanOrEqual(timestamp_ns," in text and "LessThanOrEqual(timestamp_ns," in text
    assert text.count("BroadcastHashJoin") == 2 and "NestedLoop" not in text
    assert text.count("FileScan") == 1 and "SortAggregate" not in text
    # Only three of the 21 columns are read.
    assert "ReadSchema: struct<timestamp_ns:bigint,dp_attrs:string,value_int:bigint>" in text


def test_large_dimensions_are_not_broadcast(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        averages = buckets.bucket_avg(stored, 10, start=0, end=10)
        text = plan(naming.label_series(averages, sai_types(spark), sai_stats(spark)))
        assert "SortMergeJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_variables_parse_distinct_texts_only(stored):
    for df in (catalog.var_objects(stored), catalog.var_types(stored)):
        text = plan(df)
        assert text.index("get_json_object") < text.rindex("HashAggregate(keys=[dp_attrs")


def test_top_k_is_not_a_sort(stored):
    assert "TakeOrderedAndProject" in plan(extracts.tail(stored, 5))
    assert "TakeOrderedAndProject" in plan(extracts.head(stored))


def test_large_cap_does_not_sort_the_table(stored):
    text = plan(extracts.cap_rows(stored, 100_000_000))
    assert "TakeOrdered" not in text and "rangepartitioning" not in text


def test_no_python_in_any_operator(stored):
    frames = [
        to_samples(stored), series.exposition(stored), series.label_names(stored),
        series.range_(stored, "m", cutoff=1.0), buckets.bucket_avg(stored, 0),
        catalog.metric_catalogue(stored),
        extracts.histogram_arrays(stored.select("hist_bounds", "hist_counts", F.lit(1))),
    ]
    for df in frames:
        assert "Python" not in plan(df)
