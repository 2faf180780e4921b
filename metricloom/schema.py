"""Fixed schemas: nested export requests in, flat data points out."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per data point. ``id`` is the arrival number (see sources.arrival).
POINT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp_ns", T.LongType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("metric_type", T.StringType()),
        T.StructField("resource_attrs", T.StringType()),
        T.StructField("scope_name", T.StringType()),
        T.StructField("scope_version", T.StringType()),
        T.StructField("dp_attrs", T.StringType()),
        T.StructField("value_double", T.DoubleType()),
        T.StructField("value_int", T.LongType()),
        T.StructField("is_monotonic", T.BooleanType()),
        T.StructField("aggregation_temporality", T.IntegerType()),
        T.StructField("hist_count", T.LongType()),
        T.StructField("hist_sum", T.DoubleType()),
        T.StructField("hist_min", T.DoubleType()),
        T.StructField("hist_max", T.DoubleType()),
        T.StructField("hist_bounds", T.StringType()),
        T.StructField("hist_counts", T.StringType()),
        T.StructField("extra_data", T.StringType()),
        T.StructField("start_timestamp_ns", T.LongType()),
        T.StructField("flags", T.IntegerType()),
    ]
)

METRIC_SCHEMA = T.StructType([T.StructField("id", T.LongType()), *POINT_SCHEMA.fields])

POINT_COLUMNS = POINT_SCHEMA.fieldNames()

# Name under which ad-hoc SQL sees the point table.
TABLE_NAME = "metric_data_points"

METRIC_TYPES = ["gauge", "sum", "histogram", "exp_histogram", "summary"]

# An attribute value. Scalars are typed so the JSON reader materialises them
# directly; only the two recursive members need VARIANT. 64-bit integers arrive
# as JSON strings (or numbers) and are read as text.
ANY_VALUE = T.StructType(
    [
        T.StructField("stringValue", T.StringType()),
        T.StructField("boolValue", T.BooleanType()),
        T.StructField("intValue", T.StringType()),
        T.StructField("doubleValue", T.DoubleType()),
        T.StructField("arrayValue", T.VariantType()),
        T.StructField("kvlistValue", T.VariantType()),
        T.StructField("bytesValue", T.StringType()),
    ]
)

KEY_VALUE = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("value", ANY_VALUE)]
)

_EXP_BUCKETS = T.StructType(
    [
        T.StructField("offset", T.LongType()),
        T.StructField("bucketCounts", T.ArrayType(T.StringType())),
    ]
)

_QUANTILE = T.StructType(
    [T.StructField("quantile", T.DoubleType()), T.StructField("value", T.DoubleType())]
)

# All five kinds share one superset point type, so a metric's points are a
# single array whatever its kind and unnest with one explode.
DATA_POINT = T.StructType(
    [
        T.StructField("attributes", T.ArrayType(KEY_VALUE)),
        T.StructField("startTimeUnixNano", T.StringType()),
        T.StructField("timeUnixNano", T.StringType()),
        T.StructField("flags", T.LongType()),
        T.StructField("asDouble", T.DoubleType()),
        T.StructField("asInt", T.StringType()),
        T.StructField("count", T.StringType()),
        T.StructField("sum", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("bucketCounts", T.ArrayType(T.StringType())),
        T.StructField("explicitBounds", T.ArrayType(T.DoubleType())),
        T.StructField("scale", T.IntegerType()),
        T.StructField("zeroCount", T.StringType()),
        T.StructField("zeroThreshold", T.DoubleType()),
        T.StructField("positive", _EXP_BUCKETS),
        T.StructField("negative", _EXP_BUCKETS),
        T.StructField("quantileValues", T.ArrayType(_QUANTILE)),
    ]
)

_POINTS = T.StructField("dataPoints", T.ArrayType(DATA_POINT))
_TEMPORALITY = T.StructField("aggregationTemporality", T.StringType())

METRIC = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("gauge", T.StructType([_POINTS])),
        T.StructField(
            "sum",
            T.StructType(
                [_POINTS, _TEMPORALITY, T.StructField("isMonotonic", T.BooleanType())]
            ),
        ),
        T.StructField("histogram", T.StructType([_POINTS, _TEMPORALITY])),
        T.StructField("exponentialHistogram", T.StructType([_POINTS, _TEMPORALITY])),
        T.StructField("summary", T.StructType([_POINTS])),
    ]
)

OTLP_SCHEMA = T.StructType(
    [
        T.StructField(
            "resourceMetrics",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "resource",
                            T.StructType(
                                [T.StructField("attributes", T.ArrayType(KEY_VALUE))]
                            ),
                        ),
                        T.StructField(
                            "scopeMetrics",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField(
                                            "scope",
                                            T.StructType(
                                                [
                                                    T.StructField("name", T.StringType()),
                                                    T.StructField("version", T.StringType()),
                                                ]
                                            ),
                                        ),
                                        T.StructField("metrics", T.ArrayType(METRIC)),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)
