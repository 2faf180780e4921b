"""Number text against Python's shortest representation."""

import math
import random
import struct
from decimal import Decimal

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from metricloom.functions import as_i32, as_i64, fmt_f64, json_f64, json_seconds, lenient_int

SPECIAL = [
    50.0, 72.5, 1e7, 1e21, 1e22, 1e23, 2e23, -1.5e-7, 5e-324, 1.7976931348623157e308,
    5.684341886080802e-14, 8.41e21, 2e-3, 0.0, -0.0, 123456789.125, 9007199254740992.0,
    1e15, 1e16, 1.2345e16, 9.999e-6, 1e-5, 1.234e-5, 0.1 + 0.2, 142.14 * 1e15,
    -1234567890123456.7, 2.2250738585072014e-308, 4.35, 999999.9999999999, 1e-3, 9.99e-4,
]


def plain(x: float) -> str:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    text = format(Decimal(repr(x)), "f")
    return text.removesuffix(".0")


def json_text(x: float) -> str:
    if math.isnan(x) or math.isinf(x):
        return "null"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    digits = "".join(map(str, digits)).lstrip("0")
    if not digits:
        return "-0.0" if math.copysign(1, x) < 0 else "0.0"
    point = len(digits) + exponent
    digits = digits.rstrip("0")
    if -5 < point <= 16:
        text = format(Decimal(repr(abs(x))), "f")
        body = text if "." in text else text + ".0"
    else:
        body = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{point - 1}"
    return ("-" if sign else "") + body


def check(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", fmt_f64("x").alias("p"), json_f64("x").alias("j")).collect():
        assert row.p == plain(row.x), row.x
        assert row.j == json_text(row.x), row.x


def test_special_values(spark):
    check(spark, [*SPECIAL, math.nan, math.inf, -math.inf])


def test_epoch_seconds(spark):
    rng = random.Random(11)
    values = [1e9, 9999999999.999998, 1704067200.0, 1704067207.5, 0.0, -1.5, 1e10, 999999999.9]
    values += [(1_704_067_200_000_000_000 + rng.randrange(10**16)) / 1e9 for _ in range(5000)]
    values += [rng.uniform(1e9, 1e10) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", json_seconds("x").alias("j")).collect():
        assert row.j == json_text(row.x), row.x


def test_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert df.select(fmt_f64("x"), json_f64("x")).first() == (None, "null")


def test_random_bit_patterns(spark):
    rng = random.Random(7)
    values = []
    while len(values) < 4000:
        x = struct.unpack("<d", rng.randbytes(8))[0]
        if math.isfinite(x):
            values.append(x)
    values += [rng.uniform(-1e6, 1e6) for _ in range(2000)]
    values += [round(rng.uniform(0, 1000), 2) * 10 ** rng.randint(-8, 20) for _ in range(2000)]
    check(spark, values)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=50, max_size=300))
def test_any_floats(spark, values):
    check(spark, values)


def test_unsigned_to_signed(spark):
    texts = ["42", "0", "9223372036854775807", "9223372036854775808", "18446744073709551615",
             None, "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(as_i64("t")).collect()]
    assert got == [42, 0, 2**63 - 1, -(2**63), -1, None, None]
    df = spark.createDataFrame([(0,), (2**31 - 1,), (2**31,), (2**32 - 1,)], "n bigint")
    assert [r[0] for r in df.select(as_i32("n")).collect()] == [0, 2**31 - 1, -(2**31), -1]


def test_lenient_int(spark):
    texts = ["42", "12abc", "abc", "1.9", " 7", None, "-3", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(lenient_int("t")).collect()] == [42, 12, 0, 1, 7, None, -3, 0]
    assert df.select(lenient_int("t").alias("n")).schema["n"].dataType.typeName() == "long"
    assert df.where(F.col("t").isNull()).select(lenient_int("t")).first()[0] is None
