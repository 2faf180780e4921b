"""JSON lines: one object per point, nulls included, no ``id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import POINT_SCHEMA


def jsonl_rows(points: DataFrame) -> DataFrame:
    """The fields of a line, in order. JSON has no NaN or infinity: those are null."""

    def finite(name: str):
        c = F.col(name)
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(name)

    return points.select(
        *[
            finite(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in POINT_SCHEMA.fields
        ]
    )


def write_jsonl(points: DataFrame, path: str, mode: str = "append") -> None:
    jsonl_rows(points).write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINT_SCHEMA).json(path)
