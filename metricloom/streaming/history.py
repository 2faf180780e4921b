"""Retained samples per series, kept in the state of a stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.samples import to_samples
from .ingest import start

#: Samples a state entry holds at most.
CHUNK = 512
_LABELS = "array<struct<k:string,v:string>>"
_SAMPLE = "struct<id:bigint,timestamp:double,value:double,metric_type:string>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "series_name string, label_text string, kept bigint, evicted bigint, cutoff double"


class RetainedSeries(StatefulProcessor):
    """A queue of one series' samples: appended at the back, evicted from the front.

    Samples lie in numbered chunks, so a batch reads and writes the chunks it
    evicts and the last one, never the whole series.
    """

    def __init__(self, retention: float | None, cutoff: float | None, chunk: int = CHUNK):
        self.retention, self.cutoff, self.chunk = retention, cutoff, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Chunks [first, next) are held; ``seen`` is the latest arrival.
        self.front = handle.getValueState("front", "first bigint, next bigint, kept bigint, seen double")
        self.chunks = handle.getMapState("chunks", "chunk bigint", f"samples array<{_SAMPLE}>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        new = pd.concat(rows).sort_values("id", kind="stable")
        first, after, kept, seen = self.front.get() if self.front.exists() else (0, 0, 0, -np.inf)
        if self.cutoff is None:
            seen = max(seen, float(new["arrived"].max()))
            cutoff = seen - self.retention
        else:
            cutoff = self.cutoff
        before = kept + len(new)

        while first < after:
            held = self._held(first)
            stale = _stale(np.array([s[1] for s in held], float), cutoff)
            kept -= stale
            if stale < len(held):
                if stale:
                    self.chunks.updateValue((first,), (held[stale:],))
                break
            self.chunks.removeKey((first,))
            first += 1
        if first == after:
            new = new.iloc[_stale(new["timestamp"].to_numpy(float), cutoff) :]
        kept += len(new)
        after = self._append(first, after, new)
        self.front.update((first, after, kept, float(seen)))
        yield pd.DataFrame(
            {"series_name": [key[0]], "label_text": [key[1]], "kept": [kept], "evicted": [before - kept],
             "cutoff": [cutoff]}
        )

    def _held(self, chunk: int) -> list[tuple]:
        # Plain tuples, as rows that were read cannot be written again.
        return [tuple(sample) for sample in self.chunks.getValue((chunk,))[0]]

    def _append(self, first: int, after: int, new: pd.DataFrame) -> int:
        """Store ``new`` behind chunk ``after - 1``, which is filled up first; gives the next chunk's number."""
        if not len(new):
            return after
        columns = [new["id"].tolist(), *(_nulls(new[c]) for c in ("timestamp", "value", "metric_type"))]
        rows = list(zip(*columns, strict=True))
        last = self._held(after - 1) if first < after else []
        if first < after and len(last) < self.chunk:
            after -= 1
            rows = last + rows
        for low in range(0, len(rows), self.chunk):
            self.chunks.updateValue((after,), (rows[low : low + self.chunk],))
            after += 1
        return after

    def close(self) -> None:
        pass


def _stale(timestamps: np.ndarray, cutoff: float) -> int:
    """Length of the leading run before ``cutoff``; a missing time is not fresh."""
    fresh = timestamps >= cutoff
    return int(fresh.argmax()) if fresh.any() else len(fresh)


def _nulls(values: pd.Series) -> list:
    return [None if missing else v for v, missing in zip(values.tolist(), values.isna().tolist(), strict=True)]


# The processor travels by value: Spark runs its ``init`` once in a Python
# process of the driver that gets neither the shipped Python files nor this
# package's path, so it must not need to import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def retained(
    points: DataFrame,
    retention: float | None = None,
    cutoff: float | None = None,
    arrival: str | Column | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """``CHANGES`` of the stream ``points``: per batch and series, samples kept and evicted.

    Arrival order is by batch, then by ``id``. After each batch a series drops
    the leading run of samples older than ``cutoff`` seconds or, with
    ``retention``, than its last arrival minus that. ``arrival`` is a column of
    epoch seconds; by default the time of the batch, which is part of the
    stream's log and so the same when a batch is repeated. A series without new
    samples evicts nothing.

    A batch's samples of one series meet in one task, about 40 bytes each: the
    source's batch size (``maxFilesPerTrigger``) bounds them. What a series
    retains is in the state store only and is never read as a whole.
    """
    if (retention is None) == (cutoff is None):
        raise ValueError("give either retention or cutoff")
    if arrival is None:
        arrival = F.unix_micros(F.current_timestamp()) / 1e6
    if isinstance(arrival, str):
        arrival = F.col(arrival)
    samples = to_samples(points.withColumn("_arrived", arrival.cast("double")), keep=["_arrived"])
    return (
        samples.select(
            "series_name", F.to_json("labels").alias("label_text"), "id", "timestamp", "value", "metric_type",
            F.col("_arrived").alias("arrived"),
        )
        .groupBy("series_name", "label_text")
        .transformWithStateInPandas(
            RetainedSeries(retention, cutoff, chunk), outputStructType=CHANGES, outputMode="Update", timeMode="None"
        )
    )


def run_history(
    points: DataFrame,
    checkpoint: str,
    retention: float | None = None,
    cutoff: float | None = None,
    arrival: str | Column | None = None,
    chunk: int = CHUNK,
    on_batch=None,
    **trigger,
) -> StreamingQuery:
    """Keep the samples of ``points`` in the state at ``checkpoint``; ``read_history`` reads them.

    ``on_batch(changes, batch_id)`` receives what ``retained`` gives.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if on_batch:
            on_batch(batch, batch_id)
        else:
            batch.write.format("noop").mode("overwrite").save()

    # The state has two variables, which only the RocksDB store can hold. The
    # setting is taken when the query starts and kept in its checkpoint.
    conf = points.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)
    try:
        return start(retained(points, retention, cutoff, arrival, chunk), write, checkpoint, "update", **trigger)
    finally:
        if before is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, before)


def read_history(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """``(id, series_name, labels, timestamp, value, metric_type)`` as of the last committed batch or ``batch_id``.

    Reads the state store by partition; a stream may go on meanwhile.
    """
    reader = spark.read.format("statestore").option("stateVarName", "chunks")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return (
        reader.load(checkpoint)
        .select("key.*", F.explode("user_map_value.samples").alias("s"))
        .select(
            "s.id", "series_name", F.from_json("label_text", _LABELS).alias("labels"),
            "s.timestamp", "s.value", "s.metric_type",
        )
    )
