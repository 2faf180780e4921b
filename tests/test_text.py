import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from metricloom.functions import (
    attrs_to_json,
    escape_label,
    format_labels,
    json_str,
    metric_map_json,
    parse_labels,
    sanitize_label,
    sanitize_metric,
)
from metricloom.schema import KEY_VALUE


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


def labels_of(spark, text):
    return [tuple(x) for x in one(spark, text, parse_labels("t"))]


@pytest.mark.parametrize(
    "raw, clean",
    [("foo.bar-baz", "foo_bar_baz"), ("a:b_c", "a:b_c"), ("é x", "__x"), ("", "")],
)
def test_sanitize_metric(spark, raw, clean):
    assert one(spark, raw, sanitize_metric("t")) == clean


def test_sanitize_label(spark):
    assert one(spark, "a:b.c", sanitize_label("t")) == "a_b_c"


@pytest.mark.parametrize(
    "raw, escaped", [('a"b', 'a\\"b'), ("a\\b", "a\\\\b"), ("a\nb", "a\\nb"), ("\\\n", "\\\\\\n")]
)
def test_escape_label(spark, raw, escaped):
    assert one(spark, raw, escape_label("t")) == escaped


@pytest.mark.parametrize(
    "text",
    ["plain", 'q"uote', "back\\slash", "tab\tnew\nline", "".join(map(chr, range(32))), "é/ü\x7f", ""],
)
def test_json_str(spark, text):
    literal = one(spark, text, json_str("t"))
    assert json.loads(literal) == text
    assert literal == json.dumps(text, ensure_ascii=False)


def test_labels_sorted(spark):
    assert labels_of(spark, '{"z":"1","a":"2","m":"3"}') == [("a", "2"), ("m", "3"), ("z", "1")]


@pytest.mark.parametrize("text", [None, "", "nope", "[1]", '"abc"', "{}", "17"])
def test_no_labels(spark, text):
    assert labels_of(spark, text) == []


def test_label_values_are_json_text(spark):
    text = (
        '{"n":null,"t":true,"i":7,"f":1.0,"z":1.50,"big":1e21,"huge":123456789012345678901,'
        '"u":18446744073709551615,"neg":-0,"s":"1e5","o":{"z":1, "a":[1, 2.50]},"e":[]}'
    )
    assert dict(labels_of(spark, text)) == {
        "n": "null", "t": "true", "i": "7", "f": "1.0", "z": "1.5", "big": "1e21",
        "huge": "1.2345678901234568e20", "u": "18446744073709551615", "neg": "-0.0",
        "s": "1e5", "o": '{"a":[1,2.5],"z":1}', "e": "[]",
    }


def test_label_marks_in_data_survive(spark):
    text = '{"a":"\\u0001n5","f":1.5,"o":{"p":"\\u0001s\\u001f\\\\u001F"}}'
    assert labels_of(spark, text) == [
        ("a", "\x01n5"), ("f", "1.5"), ("o", '{"p":"\\u0001s\\u001f\\\\u001F"}'),
    ]


def test_deeply_nested_label_value(spark):
    text = '{"d":' + "[" * 12 + "1.0" + "]" * 12 + "}"
    assert labels_of(spark, text) == [("d", "[" * 12 + "1.0" + "]" * 12)]


def test_colliding_label_names_keep_raw_key_order(spark):
    assert labels_of(spark, '{"a.b":"1","a_b":"2","a-b":3}') == [
        ("a_b", "3"), ("a_b", "1"), ("a_b", "2"),
    ]


def test_repeated_key_last_wins(spark):
    assert labels_of(spark, '{"a":1,"b":0,"a":2}') == [("a", "2"), ("b", "0")]


def test_format_labels(spark):
    df = spark.createDataFrame([('{"host":"n\\"1","core":"0"}',), (None,)], "t string")
    labelled = df.select(parse_labels("t").alias("l"))
    got = [r[0] for r in labelled.select(format_labels("l")).collect()]
    assert got == ['{core="0",host="n\\"1"}', ""]


def test_metric_map(spark):
    df = spark.createDataFrame([('{"a.b":"1","a_b":"2"}',)], "t string")
    text = df.select(parse_labels("t").alias("l")).select(metric_map_json("'m'", "l")).first()[0]
    assert text == '{"__name__":"m","a_b":"2"}'


def attrs(spark, kvs):
    kv_type = f"array<{KEY_VALUE.simpleString()}>"
    df = spark.createDataFrame([(json.dumps(kvs),)], "t string")
    return df.select(F.from_json("t", kv_type).alias("k")).select(attrs_to_json("k")).first()[0]


def kv(key, kind=None, value=None):
    return {"key": key} if kind is None else {"key": key, "value": {kind: value}}


def test_attribute_types(spark):
    got = attrs(
        spark,
        [
            kv("str", "stringValue", "hello"), kv("int", "intValue", "42"),
            kv("int2", "intValue", 7), kv("bool", "boolValue", True),
            kv("dbl", "doubleValue", 3.14), kv("whole", "doubleValue", 1),
            kv("nan", "doubleValue", "NaN"), kv("raw", "bytesValue", "3q2+7w=="), kv("none"),
        ],
    )
    assert got == (
        '{"bool":true,"dbl":3.14,"int":42,"int2":7,"nan":null,"none":null,'
        '"raw":"deadbeef","str":"hello","whole":1.0}'
    )


def test_empty_attributes_are_null(spark):
    assert attrs(spark, []) is None


def test_nested_attributes(spark):
    inner = [kv("z", "intValue", "1"), kv("a", "stringValue", "x"), kv("z", "boolValue", False)]
    got = attrs(
        spark,
        [
            kv("list", "arrayValue",
               {"values": [{"intValue": "4"}, {}, {"kvlistValue": {"values": inner}}]}),
            kv("empty", "arrayValue", {}), kv("none", "kvlistValue", {}),
        ],
    )
    assert got == '{"empty":[],"list":[4,null,{"a":"x","z":false}],"none":{}}'


def any_value(depth, pick):
    """A random value and the plain JSON value it stands for."""
    kind = pick.choice(["string", "int", "bool", "double", "bytes", "none", *["array", "kvlist"] * (2 if depth else 0)])
    if kind == "string":
        text = pick.choice(["", "a", 'q"\\', "{[,:]}", "tab\tnew\nline\x01", "é文\U0001f642", "arrayValue", "values"])
        return {"stringValue": text}, text
    if kind == "int":
        n = pick.choice([0, -1, 2**62, 17])
        return {"intValue": pick.choice([n, str(n)])}, n
    if kind == "bool":
        return {"boolValue": (b := pick.random() < 0.5)}, b
    if kind == "double":
        return {"doubleValue": (x := pick.choice([0.5, -2.25, 100.0]))}, x
    if kind == "bytes":
        return {"bytesValue": base64.b64encode(b := bytes([pick.randrange(256)] * pick.randrange(4))).decode()}, b.hex()
    if kind == "none":
        return {}, None
    inner = [any_value(depth - 1, pick) for _ in range(pick.randrange(4))]
    if kind == "array":
        return {"arrayValue": {"values": [v for v, _ in inner]}}, [p for _, p in inner]
    keys = [pick.choice(["b", "a", "key", "value", 'k"']) for _ in inner]
    return (
        {"kvlistValue": {"values": [{"key": k, "value": v} for k, (v, _) in zip(keys, inner)]}},
        {k: p for k, (_, p) in zip(keys, inner)},
    )


def test_values_of_any_depth(spark):
    pick = random.Random(5)
    made = [any_value(d, pick) for d in (1, 2, 3, 4, 6, 8) for _ in range(12)]
    deep, plain = {"stringValue": "x"}, "x"
    for i in range(60):
        if i % 2:
            deep, plain = {"arrayValue": {"values": [deep, {"intValue": i}]}}, [plain, i]
        else:
            deep, plain = {"kvlistValue": {"values": [{"key": f"k{i}", "value": deep}]}}, {f"k{i}": plain}
    made.append((deep, plain))
    lists = [[{"key": "v", "value": value}, {"key": "a", "value": value}] for value, _ in made]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lists)], "i int, t string")
    kinds = f"array<{KEY_VALUE.simpleString()}>"
    got = dict(df.select("i", F.from_json("t", kinds).alias("k")).select("i", attrs_to_json("k")).collect())
    for i, (_, value) in enumerate(made):
        expected = json.dumps({"a": value, "v": value}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        assert got[i] == expected


def test_values_outside_the_encoding(spark):
    odd = {"values": [None, 5, "text", [{"intValue": 1}], {"unknown": {"intValue": 1}, "intValue": "2"},
                      {"intValue": "x"}, {"kvlistValue": {"values": [None, 7, {"value": {"intValue": 3}}, {"key": "k"}]}}]}
    got = attrs(spark, [kv("a", "arrayValue", odd), kv("b", "arrayValue", {"other": [1, {"values": []}]})])
    assert got == '{"a":[null,null,null,null,2,null,{"":3,"k":null}],"b":[]}'
