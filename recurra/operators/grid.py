"""Exact row-against-row work in bounded blocks of rows.

Rows fall into about N / size blocks by hashed key. A tile of the grid is one pair of blocks; it
returns per-row partial results that Spark merges, never the pairs themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import STRIP, spread

ROWS = 512
SIDE, WIDEST = 64, 8192  # blocks along a side before blocks grow, and the most rows that they grow to


def block_count(df: DataFrame, size: int):
    """Number of blocks for a table, as a scalar subquery over its row count.

    Every block is copied once for each block of the other side. So above ``SIDE`` blocks of ``size`` rows it is the
    blocks that grow, not their number, until one holds ``WIDEST`` rows.
    """
    n = F.count(F.lit(1))
    rows = F.least(F.greatest(F.lit(size), F.ceil(n / SIDE)), F.lit(max(size, WIDEST)))
    return df.agg(F.greatest(F.ceil(n / rows), F.lit(1)).cast("long")).scalar()


def strips(count: int, size: int = STRIP):
    """Slices of a block's rows whose distances a task holds at a time."""
    return [slice(top, top + size) for top in range(0, count, size)]


def row_blocks(df: DataFrame, key: str, size: int = ROWS, more: tuple[str, ...] = ()) -> DataFrame:
    """(b, blocks, ids, labels, x, more...): blocks of rows from (key, label, x array, more...)."""
    rows = df.select(F.col(key).alias("id"), "label", "x", *more).withColumn("blocks", block_count(df, size))
    placed = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")))
    return (
        spread(placed, "b")
        .groupBy("b")
        .agg(
            F.first("blocks").alias("blocks"),
            F.array_sort(F.collect_list(F.struct("id", "label", "x", *more))).alias("_r"),
        )
        .select(
            "b", "blocks", F.col("_r.id").alias("ids"), F.col("_r.label").alias("labels"),
            F.col("_r.x").alias("x"), *[F.col(f"_r.{c}").alias(c) for c in more],
        )
    )


def block_grid(
    left: DataFrame, right: DataFrame | None = None, key: str = "row_id", size: int = ROWS, more: tuple[str, ...] = ()
) -> DataFrame:
    """One row per tile (br, bc, l_*, r_*) of two tables, or of one table's tiles br <= bc.

    Each side's blocks are copied along the other side's and meet in an equi-join on the tile.
    """
    zero = F.lit(0).cast("long")
    names = ("ids", "labels", "x", *more)
    if right is None:
        rows = cols = row_blocks(left, key, size, more)
        along_row = F.sequence(F.col("b"), F.col("blocks") - 1)
        along_col = F.sequence(zero, F.col("b"))
    else:
        rows = row_blocks(left, key, size, more).withColumn("others", block_count(right, size))
        cols = row_blocks(right, key, size, more).withColumn("others", block_count(left, size))
        along_row = along_col = F.sequence(zero, F.col("others") - 1)
    rows = rows.select(
        F.col("b").alias("br"), F.explode(along_row).alias("bc"), *[F.col(c).alias(f"l_{c}") for c in names]
    )
    cols = cols.select(
        F.explode(along_col).alias("br"), F.col("b").alias("bc"), *[F.col(c).alias(f"r_{c}") for c in names]
    )
    return spread(rows, "br", "bc").join(spread(cols, "br", "bc"), ["br", "bc"])
