"""Operator 11: whitening of vectors with distributed block matrices.

Vectors become whole numbers, floor(scale * c).  Each distinct one is a row of
the fit list; the centred rows are cut into blocks of a BlockMatrix, its
transpose times itself is the scatter, whose eigenvectors (d x d numbers, worked
out in the driver) over the roots of the eigenvalues make the whitening matrix.
The matrix of all rows times that one projects every row.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import width, written

ROWS_PER_BLOCK = 1024
COLS_PER_BLOCK = 512
#: An eigenvalue below this share of the largest is rounding: its component can't be scaled to variance 1.
NOISE = 1e-12


class Fit(NamedTuple):
    n: int  # distinct vectors
    sums: list[int]  # of each dimension over them
    eigenvalues: np.ndarray  # falling
    components: np.ndarray  # a unit vector a column
    trace: float


def whole_numbers(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows whose vector is there and has finite entries only, with ``x``: floor(scale * entry) as long."""
    infinite = float("inf")
    bad = F.exists(vector, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == infinite))
    return vectors.where(F.col(vector).isNotNull() & ~bad).withColumn("x", F.transform(vector, lambda e: F.floor(e.cast("double") * scale).cast("long")))


def padded(rows: DataFrame, d: int) -> DataFrame:
    """Vectors of fewer than d entries are filled up with zeros."""
    return rows.withColumn("x", F.when(F.size("x") == d, F.col("x")).otherwise(
        F.concat("x", F.array_repeat(F.lit(0).cast("long"), d - F.size("x")))))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows as a written table with ``index``: 0, 1, ... without a gap.

    A row's number within the task that wrote it is stored with it; those of
    earlier tasks are counted, a row for each task, so no row moves.
    """
    kept = written(rows.withColumn("_id", F.monotonically_increasing_id()))
    task = F.shiftright("_id", 33)
    counts = kept.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = counts.select("_task", F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return (kept.withColumn("_task", task).join(F.broadcast(before), "_task")  # as many rows as tasks wrote the table
            .withColumn("index", F.col("_before") + F.col("_id") - F.shiftleft("_task", 33)).drop("_id", "_task", "_before"))


def matrix(rows: DataFrame, values: str, n: int, d: int) -> BlockMatrix:
    """The rows (index, array of double) as a BlockMatrix, cut and dealt out by the JVM.

    Products read its blocks several times, so executors keep them; a lost one is made again.
    """
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(values).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(ROWS_PER_BLOCK, min(d, COLS_PER_BLOCK)).persist(StorageLevel.MEMORY_AND_DISK)


def drop(a: BlockMatrix) -> None:
    a._java_matrix_wrapper._java_model.blocks().unpersist(False)


def times(a: BlockMatrix, b: BlockMatrix, pieces: int = 1) -> BlockMatrix:
    """a * b; with ``pieces``, the inner dimension is dealt out to that many tasks for each block of the result."""
    return BlockMatrix(a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, int(pieces)), a.rowsPerBlock, b.colsPerBlock)


def covariance(a: BlockMatrix) -> np.ndarray:
    """Of centred rows, divisor n: transpose times matrix, summed over tasks before d x d numbers come to the driver."""
    n = a.numRows()
    pieces = max(1, min(width(SparkSession.active()), math.ceil(n / ROWS_PER_BLOCK)))
    scatter = times(a.transpose(), a, pieces).toLocalMatrix().toArray() / n
    return (scatter + scatter.T) / 2


def projected(a: BlockMatrix, by: np.ndarray, name: str) -> DataFrame:
    """index, ``name``: the rows of a matrix times a local one, as arrays."""
    d, k = by.shape
    high = min(d, COLS_PER_BLOCK)
    parts = [((i, 0), DenseMatrix(len(p), k, p.T.ravel().tolist())) for i, p in enumerate(by[lo:lo + high] for lo in range(0, d, high))]
    right = BlockMatrix(SparkSession.active().sparkContext.parallelize(parts, 1), high, k, d, k)
    out = times(a, right).toIndexedRowMatrix()
    return callMLlibFunc("getIndexedRows", out._java_matrix_wrapper._java_model).select("index", vector_to_array("vector").alias(name))


def centred(sums: list[int], n: int):
    """x - S/n as an array of doubles."""
    means = F.array(*[F.lit(s / n) for s in sums])
    return F.zip_with("x", means, lambda v, m: v.cast("double") - m)


def fit(list_of_x: DataFrame, d: int) -> tuple[Fit, BlockMatrix]:
    """Covariance and components of a numbered fit list, and the matrix of its centred rows."""
    n = list_of_x.count()
    sums = {r.pos: int(r.s) for r in list_of_x.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("s")).collect()}
    sums = [sums[i] for i in range(d)]
    a = matrix(list_of_x.withColumn("c", centred(sums, n)), "c", n, d)
    v = covariance(a)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    return Fit(n, sums, values[order], vectors[:, order], float(np.trace(v))), a


def whiten(vectors: DataFrame, *, vector: str = "embedding", components: int | None = None, scale: int = 256, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Each row's whitened components: ``keep``, component, n, deviation, whitened, explained, identity_error.

    ``components``: how many, from the largest eigenvalue on (all without it).
    Rows whose vector is null or holds null, NaN or infinite entries are left
    out; repeated rows stay, and count once in the fit.  Shorter vectors are
    filled up with zeros, empty ones are zero vectors.  Entries beyond the range
    of long end at its bounds.  A component without variance (one distinct
    vector, dependent dimensions) has whitened null; explained is null where the
    whole variance is 0.  ``deviation`` is exact and null beyond 64 bits.  Equal
    eigenvalues go by the order that eigh gives them.  An empty table gives an
    empty result.  The driver holds d x d numbers.
    """
    rows = whole_numbers(vectors.select(*keep, F.col(vector).alias("_v")), "_v", scale).drop("_v")
    d = rows.agg(F.max(F.size("x"))).first()[0]
    k = min(d or 0, components or d or 0)
    if not k:
        kinds = dict(rows.dtypes)
        schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["component int, n long, deviation long, whitened double, explained double, identity_error double"])
        return rows.sparkSession.createDataFrame([], schema)
    rows = numbered(padded(rows, d))
    model, fitted = fit(numbered(rows.select("x").distinct()), d)
    real = model.eigenvalues[:k] > max(NOISE * model.eigenvalues[0], 0.0)
    by = np.where(real, model.components[:, :k] / np.sqrt(np.where(real, model.eigenvalues[:k], 1.0)), 0.0)

    error = None
    if real.any():  # measured on the whitened fit list itself
        own = written(projected(fitted, by[:, real], "w"))
        means = [r.m for r in own.select(F.posexplode("w")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()]
        again = matrix(own.withColumn("w", F.zip_with("w", F.array(*map(F.lit, means)), lambda v, m: v - m)), "w", model.n, len(means))
        error = float(np.abs(covariance(again) - np.eye(len(means))).max())
        drop(again)
    drop(fitted)
    a = matrix(rows.withColumn("c", centred(model.sums, model.n)), "c", rows.count(), d)
    answers = written(projected(a, by, "w"))
    drop(a)

    wide = F.zip_with("x", F.array(*[F.lit(s).cast("decimal(38,0)") for s in model.sums]),
                      lambda v, s: F.try_subtract(F.try_multiply(v.cast("decimal(19,0)"), F.lit(model.n).cast("decimal(18,0)")).cast("decimal(38,0)"), s).cast("decimal(38,0)"))
    deviation = F.aggregate(wide, F.lit(0).cast("decimal(38,0)"), lambda a, v: F.try_add(a, F.try_multiply(v, v).cast("decimal(38,0)")).cast("decimal(38,0)"))
    whitened = F.array(*[F.when(F.lit(bool(ok)), F.col("w")[i]) for i, ok in enumerate(real)])
    explained = F.array(*[F.lit(float(e / model.trace) if model.trace > 0 else None).cast("double") for e in model.eigenvalues[:k]])
    out = rows.select("index", *keep, deviation.try_cast("long").alias("deviation")).join(answers, "index")
    return out.select(*keep, "deviation", F.posexplode(whitened).alias("_at", "whitened")).select(
        *keep, (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("_at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
