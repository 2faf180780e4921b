"""Names of counter types and statistics."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Counter type id -> name in series labels.
TYPE_NAMES = {1: "Port", 21: "Queue", 24: "BufPool", 26: "IngressPG"}

# The statistic names of each counter type, one row each.
STATISTICS = Path(__file__).with_name("port_statistics.csv")


def stat_rows(path: Path = STATISTICS) -> list[tuple[int, int, str]]:
    """(type_id, stat_id, stat_name) as the file lists them."""
    with path.open(newline="") as file:
        return [(int(r["type_id"]), int(r["stat_id"]), r["stat_name"]) for r in csv.DictReader(file)]


def values_sql(rows: list[tuple]) -> str:
    """Rows as the body of a VALUES clause, for either engine."""

    def cell(v) -> str:
        return f"CAST({v} AS BIGINT)" if isinstance(v, int) else f"'{v}'"

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def sai_types(spark: SparkSession) -> DataFrame:
    """(type_id, type_name). Inline rows, so the optimizer knows the exact size."""
    rows = values_sql(list(TYPE_NAMES.items()))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(type_id, type_name)")


def sai_stats(spark: SparkSession) -> DataFrame:
    """(type_id, stat_id, stat_name), inline rows."""
    return spark.sql(
        f"SELECT * FROM VALUES {values_sql(stat_rows())} AS t(type_id, stat_id, stat_name)"
    )
