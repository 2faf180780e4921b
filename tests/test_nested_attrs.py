"""Nested attribute values folded by the Python helper give the text of the SQL fold."""

import json

from pyspark.sql import functions as F

from metricloom.functions import _otlp, attrs_to_json_folded
from metricloom.schema import KEY_VALUE


def _deep(levels):
    value = {"stringValue": "x"}
    for n in range(levels):
        value = {"arrayValue": {"values": [{"kvlistValue": {"values": [{"key": f"k{n}", "value": value}]}}, {"intValue": str(n)}]}}
    return value


VALUES = [
    _deep(3),
    _deep(40),
    {"kvlistValue": {"values": [
        {"key": "b", "value": {"doubleValue": 1.5}}, {"key": "a", "value": {"boolValue": True}},
        {"key": "b", "value": {"intValue": "12345678901234567890"}}, {"key": "c\n\"", "value": {"bytesValue": "AAE="}},
        {"value": {"stringValue": "no key"}}, {"key": "n", "value": None}, {"key": "e", "value": {}},
    ]}},
    {"arrayValue": {"values": [1, "s", [2], None, {"doubleValue": 1e300}, {"doubleValue": -0.0}, {"stringValue": "\u0001é"}]}},
    {"arrayValue": {"values": [{"stringValue": "a", "intValue": "7"}, {"arrayValue": {"values": []}, "kvlistValue": {}}]}},
    {"arrayValue": {"other": [1], "values": "no list"}},
    {"kvlistValue": {"values": [{"key": "k", "value": {"kvlistValue": {"values": [{"key": "z", "value": {"intValue": 1.5}}]}}}]}},
]


def test_python_fold_matches_sql_fold(spark):
    texts = [json.dumps([{"key": f"a{i}", "value": v}]) for i, v in enumerate(VALUES)]
    lists = spark.createDataFrame([(t,) for t in texts], "text string").select(
        F.from_json("text", f"array<{KEY_VALUE.simpleString()}>").alias("kvs")
    )
    got = lists.select(
        attrs_to_json_folded("kvs").alias("new"), F.expr(_otlp.attrs_to_json_sql("kvs")).alias("old")
    ).collect()
    assert len(got) == len(VALUES)
    for row in got:
        assert row.new == row.old
    assert '"k39":' in got[1].new and got[1].new.count("[") == 40
