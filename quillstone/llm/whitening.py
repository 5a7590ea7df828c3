"""Whitening of embeddings with Spark MLlib's BlockMatrix.

Usable vectors are written once with a gapless row index. Centred rows become a distributed BlockMatrix; its
transpose times itself is the scatter matrix. That product is split along its long middle dimension and the
partial products are added up, so that no task holds more than a few row blocks. The eigenvectors of the
covariance (a matrix of dimension times dimension) are found on the driver, and a second BlockMatrix product
projects all rows.

Edges: rows whose vector is null or empty, or holds null, NaN or infinite entries, are left out, and so are rows
whose vector is not of the most common length (the longest of equally common ones); repeated rows and ids each
count as a row; a null id stays null; a table without usable rows gives no rows; directions without variance
have a null ``whitened`` value, and the identity error is taken over the others (zero if there are none); other
columns of any name are kept by ``whiten`` and not read by the query. A deviation beyond 64 bits is an error
(Spark's own overflow check) rather than a wrong number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.storage import read, stage

#: Numbers in a row block (4 MB of doubles), and row blocks whose products one task adds up.
BLOCK, BLOCKS_A_TASK = 1 << 19, 8
#: An eigenvalue below this share of the largest is no direction of the data.
FLAT = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What was fitted: rows, sums a dimension, eigenvalues (falling) with their vectors as columns, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def as_integers(vector: Column) -> Column:
    """floor(1024 c) + 100000 of each entry, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 1024) + F.lit(100000).cast("long"))


def usable(df: DataFrame, vector: str) -> DataFrame:
    """``row`` (all columns of ``df``), ``x`` (the entries as integers) and a gapless ``idx`` of the usable rows, written out."""
    c = F.col(vector)
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = df.where(c.isNotNull() & (F.size(c) > 0) & finite)
    common = rows.groupBy(F.size(c).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size(c) == (common["size"] if common else 0))
    place = F.monotonically_increasing_id()  # partition and place in it, kept as they are when they are written
    held = rows.select(F.struct(*df.columns).alias("row"), as_integers(c).alias("x"), F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"))
    held = stage(held, "vectors")
    parts = held.groupBy("part").agg((F.max("pos") + 1).alias("n"))  # a row for each partition
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("start"))
    return held.join(F.broadcast(starts), "part").select("row", "x", (F.coalesce("start", F.lit(0).cast("long")) + F.col("pos")).alias("idx"))


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """``rows`` (idx, values: array of doubles) as a BlockMatrix of whole rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("idx", array_to_vector("values").alias("values")), "values")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(max(1, BLOCK // width), width)


def covariance(matrix: BlockMatrix, n: int) -> np.ndarray:
    """Transpose times matrix, over n. The product's middle dimension is split, so that it is added up over many tasks."""
    splits = max(1, -(-matrix.numRowBlocks // BLOCKS_A_TASK))
    java = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    scatter = BlockMatrix(java, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()
    return (scatter + scatter.T) / (2 * n)


def centred(rows: DataFrame, values: str, means: list[float]) -> DataFrame:
    return rows.select("idx", F.zip_with(values, F.lit(means), lambda x, m: x - m).alias("values"))


def whiten(df: DataFrame, vector: str = "embedding", components: int = 8) -> tuple[DataFrame, Whitening | None, float]:
    """(rows, fit, identity error). Rows: ``row`` (the columns of ``df``), ``x`` and ``whitened``, up to ``components`` doubles."""
    spark, rows = df.sparkSession, usable(df, vector)
    # One row a dimension, so that it reaches the driver as small as the vectors are wide.
    sums = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s"), F.count("*").alias("n")).orderBy("at").collect()
    if not sums:
        return rows.select("row", "x", F.array().cast("array<double>").alias("whitened")), None, 0.0
    n, width = sums[0].n, len(sums)
    means = [s.s / n for s in sums]
    matrix = block_matrix(centred(rows, "x", means), n, width).persist(StorageLevel.MEMORY_AND_DISK)
    v = covariance(matrix, n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1].copy(), vectors[:, ::-1].copy()
    fit = Whitening(n, [s.s for s in sums], values, vectors, float(np.trace(v)))
    k = min(components, width)
    real = int(np.sum(values[:k] > max(FLAT * values[0], 0)))  # eigenvalues fall: the flat ones are the last
    if real:
        w = vectors[:, :real] / np.sqrt(values[:real])
        right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(width, real, w.T.ravel()))], 1), width, real)
        projected = callMLlibFunc("getIndexedRows", matrix.multiply(right).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        white = stage(projected.toDF("idx", "values").select("idx", vector_to_array("values").alias("values")), "whitened")
        matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)
        means = [r.m for r in white.select(F.posexplode("values").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m")).orderBy("at").collect()]
        error = float(np.abs(covariance(block_matrix(centred(white, "values", means), n, real), n) - np.eye(real)).max())
    else:
        white, error = rows.select("idx", F.array().cast("array<double>").alias("values")), 0.0
    flat = F.array_repeat(F.lit(None).cast("double"), k - real)
    return rows.join(white, "idx").select("row", "x", F.concat("values", flat).alias("whitened")), fit, error


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fit, error = whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    if fit is None:
        out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], out)
    deviation = F.aggregate(F.zip_with("x", F.lit(fit.sums).cast("array<long>"), lambda x, s: (x * F.lit(fit.n).cast("long") - s)), F.lit(0).cast("long"), lambda a, d: a + d * d)
    explained = F.lit([float(e / fit.trace) if fit.trace else 0.0 for e in fit.values])
    each = rows.select("row.vec_id", deviation.alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
