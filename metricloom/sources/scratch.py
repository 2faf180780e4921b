"""Folders for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under the shared checkpoint folder.

    ``spark.checkpoint.dir`` names storage every executor reaches. A temporary
    local folder is used only when Spark itself runs in local mode.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="metricloom-")
    return f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def written(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """``df`` computed once into a scratch table and read back.

    Cuts the lineage on storage that outlives executors. The read-back also has
    an exact size, so a following join is broadcast when the table is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffled when it is not; the
    estimate for an aggregate would always say "too large" and shuffle both
    sides. The shuffle files behind it are removed as soon as it is written, not
    when the driver happens to collect garbage, so a chain of such tables needs
    the disk of its largest step, if those that have been read go to ``dropped``.
    With ``batch_bytes`` Python functions get batches of about that size at most.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    own = {_CLEANUP: "true"}
    if batch_bytes:
        own[_BATCH] = str(batch_bytes)
    before = {name: spark.conf.get(name) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Removes the folders of tables that ``written`` gave; what is still to be computed from them would fail."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
