"""What is in the table: names, types, counts and the dashboard variable lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import attr, lenient_int
from ..functions.attributes import attr_sql

# Type ids and the text the type variable shows for them.
_TYPE_TEXT = {1: "Port", 21: "Queue", 24: "BufferPool", 26: "IngressPriorityGroup"}


def metric_catalogue(points: DataFrame) -> DataFrame:
    """Count per metric name and type, most frequent first."""
    return (
        points.groupBy("metric_name", "metric_type")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "metric_name", "metric_type")
    )


def count_by_metric(points: DataFrame) -> DataFrame:
    """Count per metric name, most frequent first."""
    return (
        points.groupBy("metric_name")
        .agg(F.count("*").alias("cnt"))
        .orderBy(F.desc("cnt"), "metric_name")
    )


def count_points(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("cnt"))


def metric_types(points: DataFrame) -> DataFrame:
    return points.select("metric_type").distinct().orderBy("metric_type")


def distinct_texts(points: DataFrame) -> DataFrame:
    """Each attribute text once, so that JSON is read per text and not per row.

    A plain distinct below another distinct is dropped by the optimizer, which
    would put the JSON parsing back on every row; testing the count keeps it.
    """
    texts = points.groupBy("dp_attrs").agg(F.count("*").alias("rows"))
    return texts.where("rows > 0").select("dp_attrs")


def var_objects(points: DataFrame) -> DataFrame:
    """Object names; rows without one give a NULL entry."""
    return (
        distinct_texts(points)
        .select(attr("dp_attrs", "object_name").alias("text"))
        .distinct()
        .orderBy("text")
    )


def var_types(points: DataFrame) -> DataFrame:
    """(value, text): raw type ids and their display text, in numeric order."""
    ids = distinct_texts(points).select(attr("dp_attrs", "sai_type_id").alias("value")).distinct()
    number = lenient_int("value")
    text = F.concat(F.lit("Type"), F.col("value"))
    for type_id, name in _TYPE_TEXT.items():
        text = F.when(number == type_id, name).otherwise(text)
    return ids.select("value", text.alias("text")).orderBy(number, "value")


def var_stats(points: DataFrame, stats: DataFrame) -> DataFrame:
    """(value, text): stat ids with ``Name (id)``, one row per type that uses the id."""
    used = (
        distinct_texts(points)
        .select(
            lenient_int(attr_sql("dp_attrs", "sai_stat_id")).alias("stat_id"),
            lenient_int(attr_sql("dp_attrs", "sai_type_id")).alias("type_id"),
        )
        .distinct()
    )
    stat_id = F.col("stat_id").cast("string")
    text = F.concat(
        F.coalesce("stat_name", F.concat(F.lit("stat"), stat_id)), F.lit(" ("), stat_id, F.lit(")")
    )
    return (
        used.join(stats, ["type_id", "stat_id"], "left")
        .orderBy("stat_id", "type_id")
        .select(stat_id.alias("value"), text.alias("text"))
    )

