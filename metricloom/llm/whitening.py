"""Whitening of embeddings with Spark MLlib block matrices.

Rows are dealt to blocks in one narrow pass, as integers and with their sums.
The centred blocks form a BlockMatrix, whose transpose times itself is the
scatter; its eigenvectors are found locally, and the BlockMatrix times the
whitening matrix gives the projected rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.batches import lists
from metricloom.sources.scratch import written

#: Entries of a block, about, and its greatest number of rows.
BLOCK_ENTRIES = 1 << 16
BLOCK_ROWS = 1024
COMPONENTS = 32
#: Entries are scaled by this, rounded down and shifted, so that all sums are exact.
SCALE = 64
SHIFT = 1_000_000

_BLOCK = T.StructType(
    [
        T.StructField("block", T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType())])),
        T.StructField("matrix", MatrixUDT()),
    ]
)


def usable_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, v array<double>)`` of the rows whose vector is whole: no null and no entry null or not finite."""
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & ~bad
    )


def common_length(vectors: DataFrame) -> tuple[int, int]:
    """The most frequent length of ``v`` over 0, of several the greatest, and its number of rows; (0, 0) if none."""
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("d > 0")
    top = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return (top["d"], top["n"]) if top else (0, 0)


@dataclass(frozen=True)
class Whitening:
    """``n`` rows of column sums ``sums``; ``vectors`` hold one unit eigenvector of their covariance a column."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def matrix(self) -> np.ndarray:
        """The whitening matrix. A component without variance is no direction: its column is NaN."""
        flat = self.values <= self.trace * len(self.sums) * np.finfo(float).eps
        return self.vectors / np.sqrt(np.where(flat, np.nan, self.values))

    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))


def _deal(rows: int, d: int, kind: pa.DataType):
    """Rows in blocks of ``rows``, each with its place (task, number), keys, entries row by row and column sums."""

    def block(task: int, at: int, keys: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([task], pa.int32()),
                pa.array([at], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys.cast(kind)),
                pa.array([x.ravel()], pa.list_(pa.int64())),
                pa.array([x.sum(axis=0)], pa.list_(pa.int64())),
            ],
            names=["task", "at", "keys", "x", "sums"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        at, keys, x = 0, [], np.zeros((0, d), np.int64)
        for batch in batches:
            own = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            keys.append(batch.column("key"))
            x = np.concatenate([x, own])
            if len(x) >= rows:
                held, start = pa.concat_arrays(keys), 0
                while len(x) - start >= rows:
                    yield block(task, at, held[start : start + rows], x[start : start + rows])
                    at, start = at + 1, start + rows
                keys, x = [held[start:]], x[start:]
        if len(x):
            yield block(task, at, pa.concat_arrays(keys), x)

    return run


def _as_block(number: int, values: np.ndarray, rows: int) -> pa.RecordBatch:
    """A dense block, filled up with rows of zeros, which add nothing to a product."""
    d = values.shape[1]
    full = np.zeros((rows, d))
    full[: len(values)] = values
    empty = pa.array([None], pa.list_(pa.int32()))
    matrix = pa.StructArray.from_arrays(
        [
            pa.array([1], pa.int8()),
            pa.array([rows], pa.int32()),
            pa.array([d], pa.int32()),
            empty,
            empty,
            pa.array([full.ravel()], pa.list_(pa.float64())),
            pa.array([True]),
        ],
        names=["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"],
    )
    place = pa.StructArray.from_arrays([pa.array([number]), pa.array([0])], names=["i", "j"])
    return pa.RecordBatch.from_arrays([place, matrix], names=["block", "matrix"])


def _values(batch: pa.RecordBatch, name: str, row: int, d: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False).reshape(-1, d)


def _block_matrix(blocks: DataFrame, rows: int, d: int, count: int) -> BlockMatrix:
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, rows, d, rows * count, d), rows, d)


def _product(left: BlockMatrix, right: BlockMatrix, rows: int, cols: int, splits: int) -> BlockMatrix:
    """``left`` times ``right``; the blocks that meet in one block of the result are added up in ``splits`` parts."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, rows, cols)


def _scatter(blocks: DataFrame, rows: int, d: int, count: int) -> np.ndarray:
    own = _block_matrix(blocks, rows, d, count)
    splits = max(1, min(count, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return _product(own.transpose(), own, d, d, splits).toLocalMatrix().toArray()


def _column_sums(table: DataFrame, column: str, d: int, dtype) -> np.ndarray:
    found = table.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(d, dtype)
    for row in found:
        out[row["at"]] = row["x"]
    return out


def _numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """``blocks`` with a dense ``number``, from one count per task that wrote some, and how many there are."""
    start, rows = 0, []
    for row in blocks.groupBy("task").agg(F.count("*").alias("n")).orderBy("task").collect():
        rows.append((row["task"], start))
        start += row["n"]
    columns = zip(*rows, strict=True) if rows else ([], [])
    # As an Arrow table the starts have a size Spark knows, and broadcasts or shuffles by.
    starts = blocks.sparkSession.createDataFrame(
        pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64()), strict=True)], names=["task", "start"])
    )
    return blocks.join(starts, "task").withColumn("number", F.col("start") + F.col("at")).drop("task", "start", "at"), start


def whiten(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``, one row per vector and component.

    Vectors that are null, empty, or hold null or non-finite entries take no part,
    nor do those of another length than the most frequent one (of several the
    greatest). Entries become integers (``SCALE``, ``SHIFT``), so column sums and
    each row's ``deviation``, the sum of ``(n * x - S)^2``, are exact; one beyond
    64 bits is null. ``whitened`` is null for a component without variance (all
    vectors equal, or fewer than components); such components are left out of
    ``identity_error``, the largest entry by which the covariance of ``whitened``
    differs from the identity. Repeated rows each count and give rows; other
    columns are not looked at; an empty table gives none.
    """
    spark = rows.sparkSession
    vectors = usable_vectors(rows, key, vector)
    d, n = common_length(vectors)
    kind = vectors.schema["key"].dataType
    result = (
        f"`{key}` {kind.simpleString()}, component int, n long, deviation long,"
        " whitened double, explained double, identity_error double"
    )
    if not n:
        return spark.createDataFrame([], result)
    size = max(1, min(BLOCK_ROWS, BLOCK_ENTRIES // d))
    x = F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT)
    dealt = written(
        vectors.where(F.size("v") == d)
        .select("key", x.alias("x"))
        .mapInArrow(
            _deal(size, d, spark.createDataFrame([], T.StructType([T.StructField("k", kind)])).toArrow().schema[0].type),
            f"task int, at long, keys array<{kind.simpleString()}>, x array<long>, sums array<long>",
        )
    )
    sums = _column_sums(dealt, "sums", d, np.int64)
    numbered, count = _numbered(dealt)

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _as_block(
                    batch.column("number")[row].as_py(), (n * _values(batch, "x", row, d) - sums) / n, size
                )

    centred = numbered.select("number", "x").mapInArrow(centre, _BLOCK)
    covariance = _scatter(centred, size, d, count) / n
    values, found = np.linalg.eigh((covariance + covariance.T) / 2)
    most = min(components, d)
    # Eigenvalues come in rising order.
    model = Whitening(
        n, sums, np.maximum(values[::-1][:most], 0.0), found[:, ::-1][:, :most].copy(), float(np.trace(covariance))
    )
    projected = _project(spark, numbered, centred, model, size, count, kind)
    error = _identity_error(projected, model, size, count)
    explained = model.explained()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys = batch.column("keys")[row].values
                white = _values(batch, "white", row, most)
                each = pa.array(np.repeat(np.arange(len(keys)), most))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(each),
                        pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), len(keys))),
                        pa.array(np.full(len(each), n)),
                        batch.column("deviation")[row].values.take(each),
                        pa.array(white.ravel(), mask=np.isnan(white.ravel())),
                        pa.array(np.tile(explained, len(keys))),
                        pa.array(np.full(len(each), error)),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return projected.select("keys", "deviation", "white").mapInArrow(spread, result)


def _project(
    spark: SparkSession, numbered: DataFrame, centred: DataFrame, model: Whitening, size: int, count: int, kind
) -> DataFrame:
    """``(number, keys, deviation, white)`` per block, written: rows times the whitening matrix, row by row."""
    n, sums, d, most = model.n, model.sums, len(model.sums), len(model.values)
    # Columns without variance are computed as zeros and marked afterwards.
    matrix = np.nan_to_num(model.matrix())
    flat = np.isnan(model.matrix()).any(axis=0)
    local = pa.Table.from_batches([_as_block(0, matrix, d)])
    whitening = spark.range(0, 1, 1, 1).mapInArrow(lambda _: iter(local.to_batches()), _BLOCK)
    product = _product(
        _block_matrix(centred, size, d, count), _block_matrix(whitening, d, most, 1), size, most, 1
    )
    found = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model).toDF("block", "matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = _values(batch, "x", row, d)
                parts = batch.column("matrix")[row]
                values = parts["values"].values.to_numpy(zero_copy_only=False)
                order = "C" if parts["isTransposed"].as_py() else "F"
                white = values.reshape((size, most), order=order)[: len(x)].copy()
                white[:, flat] = np.nan
                apart = n * x - sums
                keys = batch.column("keys").slice(row, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("number").slice(row, 1),
                        keys,
                        lists(_squares(apart), [len(x)], pa.int64()),
                        pa.array([white.ravel()], pa.list_(pa.float64())),
                    ],
                    names=["number", "keys", "deviation", "white"],
                )

    pairs = found.select(F.col("block._1").cast("long").alias("number"), "matrix").join(numbered, "number")
    return written(
        pairs.select("number", "keys", "x", "matrix").mapInArrow(
            run,
            f"number long, keys array<{kind.simpleString()}>, deviation array<long>, white array<double>",
        )
    )


def _squares(apart: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exactly; None beyond 64 bits."""
    most = int(np.abs(apart).max(initial=0))
    if most * most * apart.shape[1] < 1 << 63:
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum(x * x for x in row) for row in apart.tolist()]
    return [x if x < 1 << 63 else None for x in exact]


def _identity_error(projected: DataFrame, model: Whitening, size: int, count: int) -> float:
    """Largest entry of the covariance of the projected rows minus the identity, over components with variance."""
    n, most = model.n, len(model.values)
    kept = ~np.isnan(model.matrix()).any(axis=0)
    if not kept.any():
        return 0.0

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(most)
        for batch in batches:
            for row in range(batch.num_rows):
                sums += np.nan_to_num(_values(batch, "white", row, most)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], names=["sums"])

    means = _column_sums(projected.select("white").mapInArrow(total, "sums array<double>"), "sums", most, float) / n

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                white = np.nan_to_num(_values(batch, "white", row, most)) - means
                yield _as_block(batch.column("number")[row].as_py(), white, size)

    covariance = _scatter(projected.select("number", "white").mapInArrow(centre, _BLOCK), size, most, count) / n
    return float(np.abs(covariance - np.eye(most))[np.ix_(kept, kept)].max())
