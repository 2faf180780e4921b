import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from metricloom.schema import METRIC_SCHEMA  # noqa: E402
from metricloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.sql.shuffle.partitions": "4",
            "spark.sql.maxMetadataStringLength": "10000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_points(spark):
    """Points from dicts; ``id`` counts up in list order unless given."""

    def build(rows):
        names = METRIC_SCHEMA.fieldNames()
        full = [
            tuple({"id": i, "flags": 0, "metric_type": "gauge", **row}.get(n) for n in names)
            for i, row in enumerate(rows, 1)
        ]
        return spark.createDataFrame(full, METRIC_SCHEMA)

    return build
