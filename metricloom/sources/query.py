"""Read-only ad-hoc SQL and its JSON result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.binding import quote
from ..functions.numbers import json_f64_sql
from ..functions.text import json_str_sql

DEFAULT_LIMIT = 10_000


def query(spark: SparkSession, sql: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """At most ``limit`` rows of one SELECT (or WITH) statement.

    The statement runs as a subquery, so nothing but a query can be parsed
    there: WITH cannot smuggle in an INSERT.
    """
    text = sql.strip().rstrip(";")
    if not text:
        raise ValueError("the statement is empty")
    if text.split()[0].upper() not in ("SELECT", "WITH"):
        raise ValueError("the statement must start with SELECT or WITH")
    return spark.sql(f"SELECT * FROM (\n{text}\n)").limit(limit)


def _cell(c: str, data_type: T.DataType) -> str:
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        x = f"CAST({c} AS DOUBLE)"
        return (
            f"CASE WHEN {x} = floor({x}) AND abs({x}) < 9223372036854775807D"
            f" THEN CAST(CAST({x} AS BIGINT) AS STRING) ELSE {json_f64_sql(x)} END"
        )
    if isinstance(data_type, T.BooleanType):
        return f"CAST(CAST({c} AS INT) AS STRING)"
    if isinstance(data_type, T.NumericType):
        return f"CAST({c} AS STRING)"
    if isinstance(data_type, (T.BinaryType, T.NullType)):
        return "'null'"
    if isinstance(data_type, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return f"to_json({c})"
    return json_str_sql(f"CAST({c} AS STRING)")


def rows_as_json(df: DataFrame, name: str = "row") -> DataFrame:
    """Each row as a JSON object: keys in order, the last of equal names wins.

    Whole doubles print as integers and booleans as 0/1; NULL and binary are
    null. BIGINT stays exact.
    """
    positions = {field.name: i for i, field in enumerate(df.schema.fields)}
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    members = [
        f"concat({json_str_sql(quote(column))}, ':',"
        f" coalesce({_cell(f'c{i}', df.schema.fields[i].dataType)}, 'null'))"
        for column, i in sorted(positions.items())
    ]
    body = f"concat_ws(',', {', '.join(members)})" if members else "''"
    return numbered.select(F.expr(f"concat('{{', {body}, '}}')").alias(name))
