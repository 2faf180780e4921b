"""Scalar functions.

Each function is written once as Spark SQL expression text (``*_sql``), because
text is parsed in a single call while a deep Column tree costs one gateway call
per node. The names exported here take a column name or any SQL expression text
and give a Column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, SparkSession, functions as F

from . import attributes as _attributes
from . import numbers as _numbers
from . import otlp as _otlp
from . import text as _text


def _column(build: Callable[..., str]) -> Callable[..., Column]:
    @wraps(build)
    def column(*args, **options) -> Column:
        return F.expr(build(*args, **options))

    column.__name__ = build.__name__.removesuffix("_sql")
    return column


attr = _column(_attributes.attr_sql)
lenient_int = _column(_attributes.lenient_int_sql)
parse_labels = _column(_attributes.parse_labels_sql)
as_i32 = _column(_numbers.as_i32_sql)
as_i64 = _column(_numbers.as_i64_sql)
fmt_f64 = _column(_numbers.fmt_f64_sql)
json_f64 = _column(_numbers.json_f64_sql)
json_seconds = _column(_numbers.json_seconds_sql)
any_value_to_json = _column(_otlp.any_value_to_json_sql)
attrs_to_json = _column(_otlp.attrs_to_json_sql)
escape_label = _column(_text.escape_label_sql)
format_labels = _column(_text.format_labels_sql)
json_str = _column(_text.json_str_sql)
metric_map_json = _column(_text.metric_map_json_sql)
sanitize_label = _column(_text.sanitize_label_sql)
sanitize_metric = _column(_text.sanitize_metric_sql)

_NESTED_PARTS = "metricloom_nested_parts"


def attrs_to_json_folded(attributes: str) -> Column:
    """``attrs_to_json``, but nested arrays and key-value lists are folded per row by a Python helper
    (``otlp.nested_parts``), registered as a function of the active session;
    scalars and keys are formatted in SQL.
    """
    spark = SparkSession.getActiveSession()
    spark.udf.register(
        _NESTED_PARTS,
        F.udf(
            lambda items: None if items is None else [
                None if item is None else _otlp.nested_parts(item["kind"], item["text"]) for item in items
            ],
            _otlp.NESTED_PARTS,
        ),
    )
    return F.expr(_otlp.attrs_to_json_sql(attributes, _NESTED_PARTS))


__all__ = [
    "any_value_to_json",
    "as_i32",
    "as_i64",
    "attr",
    "attrs_to_json",
    "attrs_to_json_folded",
    "escape_label",
    "fmt_f64",
    "format_labels",
    "json_f64",
    "json_seconds",
    "json_str",
    "lenient_int",
    "metric_map_json",
    "parse_labels",
    "sanitize_label",
    "sanitize_metric",
]
