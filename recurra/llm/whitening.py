"""Whitening of embeddings with distributed block matrices: centred rows, their scatter, and their projection.

Rows are numbered and indexed into blocks; blocks transposed times blocks give the scatter matrix, whose eigenvectors
are found locally (it is components x components); blocks times the whitening matrix give the projected rows.

* Entries are first made whole numbers, floor(64 c) + 1 000 000, so that sums and deviations are exact. Centring uses
  the exact difference n x - S, divided by n once.
* The product of blocks is dealt into parts of the long side, and the parts' small products are added up; left alone,
  it would gather all blocks in the one task that owns the result.
* The driver plans a product from the blocks' numbers. Rows are therefore worked on in stripes of a fixed number of
  rows (STRIPE), which also keeps the blocks' 32-bit numbering; a scatter is the sum over stripes.
* Rows whose vector is null or holds a null or non-finite entry take no part, nor do vectors of another length than
  most (of equally many, the shorter). Entries beyond 2**40 count as 2**40. Repeated rows and null ids are rows like
  others. Components without variance, up to rounding, have no whitened value (null); without any variance there is no
  explained share and no identity error (null). A deviation beyond a long is null. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

BLOCK_ROWS, BLOCK_COLUMNS = 1024, 1024
BLOCKS_A_TASK = 16  # blocks of the long side that one task of a product holds
STRIPE = 1 << 27
LARGEST = float(1 << 40)
SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whole_rows(vectors: DataFrame) -> DataFrame:
    """(index, vec_id, x): the rows that take part, numbered from 0 without gaps, with whole-number entries."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & finite)
    held = F.transform("v", lambda c: F.floor(64 * F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST))) + 1_000_000)
    placed = stage(rows.select("vec_id", held.alias("x"), F.monotonically_increasing_id().alias("_at")))
    common = placed.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if common is not None:
        placed = placed.filter(F.size("x") == common.d)
    # Row numbers inside a written part, shifted by the sizes of the parts before: one row per part is ordered.
    part = F.shiftright("_at", 33)
    inside = Window.partitionBy(part).orderBy("_at")
    placed = placed.select("*", part.alias("_part"), (F.row_number().over(inside) - 1).cast("long").alias("_row"))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = stage(sizes.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift")))
    index = F.col("_row") + F.col("_shift")
    return stage(placed.join(shifts, "_part").select(index.alias("index"), "vec_id", "x"))


def blocks(rows: DataFrame, width: int) -> BlockMatrix:
    """Distributed blocks of rows(index, v)."""
    ready = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("vector")), "vector")
    return IndexedRowMatrix(ready, 0, width).toBlockMatrix(BLOCK_ROWS, min(width, BLOCK_COLUMNS))


def stripes(rows: DataFrame, n: int):
    """(first index, rows numbered from 0) of each stripe."""
    for first in range(0, n, STRIPE):
        part = rows.filter((F.col("index") >= first) & (F.col("index") < first + STRIPE)) if n > STRIPE else rows
        yield first, part.withColumn("index", F.col("index") - first)


def scatter(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """Sum of v v^T over rows(index, v)."""
    total = np.zeros((width, width))
    for first, part in stripes(rows, n):
        long_side = -(-min(STRIPE, n - first) // BLOCK_ROWS)
        matrix = blocks(part, width)
        turned = matrix.transpose()
        product = turned._java_matrix_wrapper.call(
            "multiply", matrix._java_matrix_wrapper._java_model, -(-long_side // BLOCKS_A_TASK)
        )
        total += BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()
    return total


def projected(rows: DataFrame, n: int, width: int, weights: np.ndarray) -> DataFrame:
    """(index, z): rows(index, v) times the weights."""
    context = rows.sparkSession.sparkContext
    high = min(width, BLOCK_COLUMNS)
    pieces = [
        ((k // high, 0), Matrices.dense(len(w), w.shape[1], w.ravel(order="F")))
        for k in range(0, width, high)
        for w in [weights[k : k + high]]
    ]
    right = BlockMatrix(context.parallelize(pieces, 1), high, weights.shape[1])
    found = None
    for first, part in stripes(rows, n):
        product = blocks(part, width).multiply(right).toIndexedRowMatrix()
        table = MLUtils.convertVectorColumnsToML(callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model), "vector")
        own = table.select((F.col("index") + first).alias("index"), vector_to_array("vector").alias("z"))
        found = own if found is None else found.unionByName(own)
    return found


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and weights of the first `most`, and which of them have variance.

    A weight column is the eigenvector over the root of its eigenvalue, its largest entry positive.
    """
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    alive = values > max(values[0], 0.0) * len(covariance) * np.finfo(float).eps
    return values, vectors[:, alive] * signs[alive] / np.sqrt(values[alive]), alive


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component up to `most`."""
    spark = vectors.sparkSession
    rows = whole_rows(vectors)
    sums = rows.select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    sums = sums.orderBy("k").collect()  # one row per component
    if not sums:
        return spark.createDataFrame([], SCHEMA)
    n, width = sums[0].n, len(sums)
    s = F.array(*[F.lit(row.s) for row in sums])
    gap = F.zip_with("x", s, lambda x, t: F.try_subtract(F.try_multiply(F.lit(n), x), t))
    plain = F.zip_with("x", s, lambda x, t: x - t / F.lit(float(n)))
    centred = F.zip_with(gap, plain, lambda g, p: F.coalesce(g / F.lit(float(n)), p))
    square: Column = F.aggregate(gap, F.lit(0).cast("long"), lambda a, g: F.try_add(a, F.try_multiply(g, g)))
    lines = rows.select("index", centred.alias("v"))
    covariance = scatter(lines, n, width) / n
    values, weights, alive = components(covariance, most)
    trace = float(np.trace(covariance))
    known = rows.select("index", "vec_id", square.alias("deviation"))
    error = None
    if alive.any():
        z = projected(lines, n, width, weights)
        known = stage(known.join(z, "index"))
        kept = weights.shape[1]
        means = known.select(F.posexplode("z").alias("k", "z")).groupBy("k").agg(F.avg("z").alias("m")).orderBy("k").collect()
        flat = F.zip_with("z", F.array(*[F.lit(row.m) for row in means]), lambda a, m: a - m)
        unit = scatter(known.select("index", flat.alias("v")), n, kept) / n
        error = float(np.abs(unit - np.eye(kept)).max())
    else:
        known = known.withColumn("z", F.array().cast("array<double>"))
    # Components with variance come first, so their number is the position in z.
    shares = [float(v) / trace if trace > 0 else None for v in values]
    parts = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.lit(share).cast("double").alias("explained")) for k, share in enumerate(shares)])
    each = known.select("vec_id", "deviation", "z", F.explode(parts).alias("p"))
    return each.select(
        "vec_id",
        "p.component",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.get("z", F.col("p.component") - 1).alias("whitened"),
        "p.explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
