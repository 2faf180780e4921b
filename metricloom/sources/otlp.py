"""Export requests in OTLP's JSON encoding, one request per line, and the audit that sets bad ones apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.numbers import as_i64_sql, unsigned_text_sql
from ..schema import OTLP_SCHEMA

#: Holds the text of a line that is no request; null for one that is.
CORRUPT = "_corrupt"
_READ_SCHEMA = T.StructType([*OTLP_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])

# Why a request is rejected.
NOT_A_REQUEST = "not a request"
BAD_NUMBER = "unreadable number"

_KINDS = ("gauge", "sum", "histogram", "exponentialHistogram", "summary")


def read_otlp(spark: SparkSession, path: str, streaming: bool = False, **options) -> DataFrame:
    """Requests with a fixed schema, as a batch or a stream of files.

    A line that is no request (broken JSON, or a member of another type) has its
    text in ``_corrupt``; ``flatten(..., rejects=True)`` sets it apart. The
    ``_file...`` columns record where a request came from, for arrival ids.
    """
    reader = spark.readStream if streaming else spark.read
    return (
        reader.schema(_READ_SCHEMA)
        .options(columnNameOfCorruptRecord=CORRUPT, **options)
        .json(path)
        .select(
            "*",
            F.unix_micros("_metadata.file_modification_time").alias("_file_time"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )


def parse_otlp(texts: DataFrame, column: str = "value") -> DataFrame:
    """Requests from a text column, such as a message queue's value; ``_corrupt`` as in ``read_otlp``."""
    parsed = F.from_json(column, _READ_SCHEMA, {"columnNameOfCorruptRecord": CORRUPT})
    others = [c for c in texts.columns if c != column]
    return texts.select(*others, parsed.alias("_r")).select(*others, "_r.*")


def _unreadable(text: str, readable: str) -> str:
    return f"({text} IS NOT NULL AND {readable} IS NULL)"


def _any(items: str, var: str, test: str) -> str:
    return f"coalesce(exists({items}, {var} -> {test}), false)"


def _bad_attribute(attributes: str) -> str:
    number = "av.value.intValue"
    return _any(attributes, "av", _unreadable(number, f"try_cast({number} AS BIGINT)"))


def _bad_point(p: str) -> str:
    """Whether a point has a number that is there but cannot be read, or a hole in its counts."""
    numbers = [
        _unreadable(f"{p}.{c}", as_i64_sql(f"{p}.{c}")) for c in ("timeUnixNano", "startTimeUnixNano", "count", "zeroCount")
    ]
    numbers.append(_unreadable(f"{p}.asInt", f"try_cast({p}.asInt AS BIGINT)"))
    counts = [
        _any(f"{p}.{c}", "ac", f"{unsigned_text_sql('ac')} IS NULL")
        for c in ("bucketCounts", "positive.bucketCounts", "negative.bucketCounts")
    ]
    return " OR ".join([*numbers, *counts, _bad_attribute(f"{p}.attributes")])


def request_error_sql() -> str:
    """Why a request is rejected, or NULL: every number it gives as text has to be readable."""
    points = " OR ".join(_any(f"am.{kind}.dataPoints", "ap", _bad_point("ap")) for kind in _KINDS)
    scopes = _any("ar.scopeMetrics", "asm", _any("asm.metrics", "am", points))
    resources = _any("resourceMetrics", "ar", f"{_bad_attribute('ar.resource.attributes')} OR {scopes}")
    return f"CASE WHEN {CORRUPT} IS NOT NULL THEN '{NOT_A_REQUEST}' WHEN {resources} THEN '{BAD_NUMBER}' END"


def accepted(flat: DataFrame) -> DataFrame:
    """The points of ``flatten(..., rejects=True)``."""
    return flat.where("_rejected IS NULL").drop("_rejected")


def rejected(flat: DataFrame, *keep: str) -> DataFrame:
    """``(line, reason)`` and the columns ``keep`` of each request that ``flatten(..., rejects=True)`` set apart."""
    return flat.where("_rejected IS NOT NULL").select(*keep, "_rejected.line", "_rejected.reason")
