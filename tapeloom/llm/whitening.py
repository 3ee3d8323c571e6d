"""Whitening of embedding vectors with distributed block matrices.

Vectors become numbered rows of whole numbers. Their centred rows form a
`BlockMatrix` of tall blocks. Its transpose times itself is the scatter matrix,
whose size depends on the dimensions alone; that small matrix is taken apart on
the driver, and a second block multiplication projects all rows.

The product over the rows is cut along them, a few blocks to a part, and the
parts' small results are added, so no task holds more than those blocks. Only
the sums per dimension and the small products come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.session import stage

SCALE, OFFSET = 64, 1_000_000
#: Entries that reach this value when scaled fit no exact sum and count as not finite.
_LARGE = float(1 << 53)
_NTH = 33  # monotonically_increasing_id() numbers the rows of a task in its lower 33 bits
_LONG = (1 << 63) - 1
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Basis:
    """What the fit knows: rows, exact sums, the eigenvalues from the largest on and their unit vectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def scaled(self) -> np.ndarray:
        """The matrix that projects a centred row on each component and divides by its deviation; 0 without variance."""
        sound = self.values > 1e-12 * max(self.trace, 0.0)
        return self.vectors * np.where(sound, 1.0 / np.sqrt(np.where(sound, self.values, 1.0)), 0.0)


def whole_rows(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`_row` (each number once), `_key` and `_x`, the entries as whole numbers floor(64 c) + 1000000.

    A vector is dropped if it is null or empty, holds a null or an entry that is
    not finite (or reaches 2^53 when scaled), or is shorter than the longest one:
    the entries it lacks count as null.
    """
    c = F.col(vector).cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * float(SCALE) < _LARGE))
    made = F.transform(c, lambda v: F.floor(v * float(SCALE)).cast("long") + OFFSET)
    given = vectors.select(F.col(key).cast("long").alias("_key"), F.when(fine, made).alias("_x")).where("size(_x) > 0")
    given = stage(given.withColumn("_id", F.monotonically_increasing_id()), "vectors")
    longest = given.agg(F.max(F.size("_x"))).first()[0] or 0
    given = given.withColumn("_part", F.shiftright("_id", _NTH)).withColumn("_nth", F.col("_id").bitwiseAND((1 << _NTH) - 1))
    # One row per writing task: where its numbers start.
    sizes = given.groupBy("_part").agg((F.max("_nth") + 1).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    numbered = given.where(F.size("_x") == longest).join(starts, "_part")
    return numbered.select((F.col("_start") + F.col("_nth")).alias("_row"), "_key", "_x")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension; tasks add up their batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                high, low = (x >> 24).sum(0), (x & 0xFFFFFF).sum(0)
                columns = [pa.array(np.arange(x.shape[1])), pa.array(high), pa.array(low), pa.array(np.full(x.shape[1], len(x)))]
                yield pa.RecordBatch.from_arrays(columns, ["at", "high", "low", "n"])

    parts = rows.select("_x").mapInArrow(run, "at long, high long, low long, n long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]
    found = sorted(parts.groupBy("at").agg(*exact).collect(), key=lambda r: r["at"])
    return (int(found[0]["n"]), [(int(r["high"]) << 24) + int(r["low"]) for r in found]) if found else (0, [])


def centred_rows(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """`_row`, `_key`, `deviation` (exact sum of (n x - S)^2; null beyond 64 bits) and `_centred` (x - S / n)."""
    total = np.array(sums, object)
    # Whole numbers of 64 bits suffice as long as no step can leave them.
    small = n < 1 << 31 and all(abs(s) < 1 << 61 for s in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("_x"))
            if small and int(np.abs(x).max()) < (1 << 61) // n:
                moved = x * n - total.astype(np.int64)
                most = int(np.abs(moved).max())
            else:
                moved, most = x.astype(object) * n - total, _LONG
            wide = moved if most * most * x.shape[1] <= _LONG else moved.astype(object)
            squares = [s if s <= _LONG else None for s in (wide * wide).sum(1).tolist()]
            flat = (moved / n).astype(np.float64).ravel()
            centred = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(flat))
            columns = [batch.column("_row"), batch.column("_key"), pa.array(squares, pa.int64()), centred]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "_key", "deviation", "_centred"])

    return rows.mapInArrow(run, "_row long, _key long, deviation long, _centred array<double>")


def blocks(rows: DataFrame, column: str, block_rows: int, width: int) -> BlockMatrix:
    """The arrays of a column as blocks of `block_rows` rows; numbers that do not occur are rows of zeros."""
    given = rows.select(F.col("_row"), array_to_vector(column).alias("_vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(given, "_vector")).toBlockMatrix(block_rows, width)


def _times(left: BlockMatrix, right: BlockMatrix, parts: int) -> BlockMatrix:
    """left x right, its inner dimension cut into parts that are added up; only the JVM method takes that number."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def scatter(rows: DataFrame, column: str, width: int, block_rows: int, part_blocks: int) -> np.ndarray:
    """Transpose times itself: a matrix of width x width."""
    matrix = blocks(rows, column, block_rows, width)
    parts = max(1, -(-matrix.numRows() // (block_rows * part_blocks)))
    return _times(matrix.transpose(), matrix, parts).toLocalMatrix().toArray()


def fit(rows: DataFrame, block_rows: int = 4096, part_blocks: int = 4) -> Basis:
    """Eigenvalues and unit eigenvectors of the covariance (divisor n) of all rows of `whole_rows`."""
    n, sums = totals(rows)
    if not n:
        return Basis(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    covariance = scatter(centred_rows(rows, n, sums), "_centred", len(sums), block_rows, part_blocks) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    return Basis(n, sums, np.maximum(values[::-1], 0.0), vectors[:, ::-1], float(np.trace(covariance)))


def project(rows: DataFrame, basis: Basis, components: int, block_rows: int = 4096) -> DataFrame:
    """`_row` and `_whitened`, the row on each of the first components over the component's deviation."""
    spark = rows.sparkSession
    white = basis.scaled()[:, :components]
    height, width = white.shape
    local = spark.sparkContext.parallelize([((0, 0), DenseMatrix(height, width, white.ravel(order="F")))], 1)
    matrix = blocks(centred_rows(rows, basis.n, basis.sums), "_centred", block_rows, height)
    made = matrix.multiply(BlockMatrix(local, height, width)).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", made._java_matrix_wrapper._java_model)
    return found.select(F.col("index").alias("_row"), vector_to_array("vector").alias("_whitened"))


def whiten(vectors: DataFrame, components: int = 32, *, key: str = "vec_id", vector: str = "embedding", block_rows: int = 4096, part_blocks: int = 4) -> DataFrame:
    """One row per remaining vector (see `whole_rows`) and component.

    vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened,
    explained, identity_error. Components without variance have whitened 0 and are
    left out of identity_error; without any variance, explained and identity_error
    are null. Repeated and null keys are rows of their own, other columns are
    ignored, and no remaining vector gives no rows. Vectors with fewer dimensions
    than `components` have as many components as dimensions.
    """
    spark: SparkSession = vectors.sparkSession
    rows = stage(whole_rows(vectors, key, vector), "whole-vectors")
    basis = fit(rows, block_rows, part_blocks)
    if not basis.n:
        return spark.createDataFrame([], RESULT)
    used = min(components, len(basis.sums))
    made = stage(project(rows, basis, used, block_rows), "whitened")
    sound = np.flatnonzero(np.abs(basis.scaled()[:, :used]).max(axis=0) > 0)
    error = None
    if len(sound):
        own = rows.select("_row").join(made, "_row")
        gram = scatter(own, "_whitened", used, block_rows, part_blocks) / basis.n
        error = float(np.abs(gram[np.ix_(sound, sound)] - np.eye(len(sound))).max())
    share = [float(v / basis.trace) if basis.trace > 0 else None for v in basis.values[:used]]
    shares = F.array(*[F.lit(s).cast("double") for s in share])
    facts = centred_rows(rows, basis.n, basis.sums).select("_row", "_key", "deviation")
    each = facts.join(made, "_row").select("_key", "deviation", F.posexplode("_whitened").alias("_at", "whitened"))
    return each.select(
        F.col("_key").alias("vec_id"), (F.col("_at") + 1).alias("component"), F.lit(basis.n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(shares, F.col("_at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
