"""Whitening of embeddings with distributed block matrices.

Vectors are put on an integer grid (x = floor(scale * c)), so that counts, sums and deviations are exact. The fit list
holds each distinct x once. Its centred rows are numbered without gaps and cut into blocks of an MLlib BlockMatrix;
transpose times matrix gives the scatter matrix (its middle dimension is split, so no task multiplies more than a few
blocks), a local eigendecomposition of that dimension x dimension matrix gives the components, and a second
BlockMatrix multiplication by the whitening matrix projects rows: those of the fit list, to measure how far the covariance of
the result is from the identity, and all rows. Projected rows come back by their number, which is unique, so copies
of one vector never meet under one key. Only sums and matrices of the dimension's size reach the driver, and the block
coordinates that MLlib plans with (one for each `block_bytes` of rows).

Defined cases: a vector that is null or holds a null, NaN or infinite entry is dropped, and so is one of fewer entries
than the longest (what it lacks counts as null); repeated rows are rows of their own and one row of the fit list; null
ids are carried through; components of no variance (up to rounding) are left out, so an empty table, one distinct
vector or vectors without entries give no row; `deviation` is null where it passes 64 bits. Other columns are not read, so their
names cannot clash. Equal eigenvalues leave the choice of components open.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import staged

BLOCK_BYTES = 2 << 20
BLOCKS_A_TASK = 8


@dataclass(frozen=True)
class Whitening:
    n: int                    # vectors of the fit list
    sums: list[int]           # of the fit list, by dimension
    eigenvalues: np.ndarray   # of the covariance, falling
    matrix: np.ndarray        # dimension x components: unit eigenvectors over the roots of their eigenvalues
    identity_error: float     # largest entry of |covariance of the whitened fit list - identity|

    @property
    def explained(self) -> list[float]:
        return (self.eigenvalues / self.eigenvalues.sum())[:self.matrix.shape[1]].tolist()


def _numbered(rows: DataFrame) -> DataFrame:
    """Staged rows with `uid` get a gapless `index`, by prefix sums over the counts of their partitions (one row for each)."""
    part = F.shiftright("uid", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return (rows.withColumn("part", part).join(F.broadcast(bases), "part")
            .withColumn("index", F.col("base") + F.col("uid").bitwiseAND(F.lit((1 << 33) - 1))).drop("uid", "part", "base"))


def on_grid(vectors: DataFrame, vec_id: str, vector: str, scale: int = 256) -> DataFrame:
    """vec_id, x (longs) and index of the usable rows; staged."""
    good = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(vectors[vec_id].alias("vec_id"), vectors[vector].cast("array<double>").alias("c")).where(F.col("c").isNotNull() & good)
    rows = rows.select("vec_id", F.transform("c", lambda c: F.floor(c * scale)).alias("x"), F.monotonically_increasing_id().alias("uid"))
    rows = staged(rows, "grid")
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return _numbered(rows).where((F.size("x") == longest) & (F.size("x") > 0))


def _difference(n: int, sums: list[int]) -> Column:
    """n * x - S of each entry, exact."""
    return F.zip_with("x", F.lit(sums), lambda x, s: x * F.lit(n) - s)


def _blocks(rows: DataFrame, n: int, sums: list[int]) -> BlockMatrix:
    """The centred rows (index, x) as blocks of about BLOCK_BYTES."""
    centred = rows.select("index", array_to_vector(F.transform(_difference(n, sums), lambda d: d.cast("double") / n)).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "vector"), 0, len(sums))
    return matrix.toBlockMatrix(max(1, BLOCK_BYTES // (8 * len(sums))), len(sums))


def _gram(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times matrix. The blocks along the rows are shared out over tasks, BLOCKS_A_TASK to each, and their products added."""
    java = blocks._java_matrix_wrapper._java_model
    found = java.transpose().multiply(java, max(1, -(-blocks.numRowBlocks // BLOCKS_A_TASK)))
    return BlockMatrix(found, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def _projected(spark: SparkSession, blocks: BlockMatrix, matrix: np.ndarray) -> BlockMatrix:
    local = Matrices.dense(*matrix.shape, matrix.ravel(order="F"))
    return blocks.multiply(BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), *matrix.shape))


def fitted(grid: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of the rows' distinct vectors; None where nothing varies."""
    spark = grid.sparkSession
    distinct = _numbered(staged(grid.select("x").distinct().withColumn("uid", F.monotonically_increasing_id()), "distinct"))
    sums = distinct.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s"), F.count("*").alias("n")).orderBy("pos").collect()  # one row for each dimension
    if not sums:
        return None
    n, total = sums[0]["n"], [r["s"] for r in sums]
    blocks = _blocks(distinct, n, total)
    covariance = _gram(blocks) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    used = int((values[:components] > len(values) * np.finfo(float).eps * values[0]).sum())
    if not used:
        return None
    matrix = vectors[:, :used] / np.sqrt(values[:used])
    error = np.abs(_gram(_projected(spark, blocks, matrix)) / n - np.eye(used)).max()
    return Whitening(n, total, values, matrix, float(error))


def whitened(grid: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, x, deviation and whitened (an array of the components) of every row."""
    found = _projected(grid.sparkSession, _blocks(grid, model.n, model.sums), model.matrix).toIndexedRowMatrix()
    back = MLUtils.convertVectorColumnsToML(callMLlibFunc("getIndexedRows", found._java_matrix_wrapper._java_model), "vector")
    squares = F.aggregate(_difference(model.n, model.sums), F.lit(0).cast("long"), lambda total, d: F.try_add(total, F.try_multiply(d, d)))
    return grid.join(back.select("index", vector_to_array("vector").alias("whitened")), "index").select("vec_id", "x", squares.alias("deviation"), "whitened")


def whitening_report(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """A row for each usable row and component: n, deviation, whitened value, share of the variance, and the identity error."""
    grid = on_grid(vectors, vec_id, vector, scale)
    model = fitted(grid, components)
    if model is None:
        kind = vectors.schema[vec_id].dataType.simpleString()
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = whitened(grid, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(F.lit(model.explained), F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
