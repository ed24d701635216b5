"""Kendall's rank agreement of all feature pairs by counting inversions, in n log n work a pair.

Every feature cuts its range at quantiles from Spark's mergeable sketch. A pair of rows is counted once: inside a chunk
of the first feature by sorting, inside a chunk of the second by sorting (rows of one first chunk tie there), or from
the numbers of rows in the cells of the chunk grid. A border value is a chunk of its own: however many rows share it,
they tie with each other, so nothing of it is ever gathered.

Chunks hold about SORT_ROWS rows up to MOST_CHUNKS times as many rows in all, and grow in proportion beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

SORT_ROWS, MOST_CHUNKS = 1 << 15, 1024
SUMS = "a int, b int, s double"


def agreement(u: np.ndarray, v: np.ndarray) -> float:
    """Sum over pairs of sign(u_i - u_j) * sign(v_i - v_j)."""
    n = len(u)
    order = np.lexsort((v, u))
    _, u = np.unique(u[order], return_inverse=True)
    _, v = np.unique(v[order], return_inverse=True)

    def tied(ids: np.ndarray) -> int:
        _, c = np.unique(ids, return_counts=True)
        return int((c * (c - 1) // 2).sum())

    # Inversions bit by bit: among values that agree in the higher bits, the ones that stand before a zero.
    inverted, at = 0, np.arange(n)
    for bit in range(int(v.max(initial=0)).bit_length() - 1, -1, -1):
        high = v[at] >> (bit + 1)
        one = (v[at] >> bit) & 1
        ones = np.cumsum(one)
        first = np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1])))
        before = np.repeat((ones - one)[first], np.diff(np.concatenate((first, [n]))))
        inverted += int((ones - before)[one == 0].sum())
        at = at[np.lexsort((one, high))]  # stable: the old order inside equal prefixes
    both = tied(u * (int(v.max(initial=0)) + 1) + v)
    return float(n * (n - 1) // 2 - tied(u) - tied(v) + both - 2 * inverted)


def grid_agreement(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    """The same over rows given as counts c of cells (a, b)."""
    _, row = np.unique(a, return_inverse=True)
    _, column = np.unique(b, return_inverse=True)
    counts = np.zeros((row.max() + 1, column.max() + 1))
    np.add.at(counts, (row, column), c)
    below = np.zeros_like(counts)  # rows of smaller a, by b
    np.cumsum(counts[:-1], axis=0, out=below[1:])
    smaller = np.cumsum(below, axis=1) - below
    larger = below.sum(axis=1, keepdims=True) - smaller - below
    return float((counts * (smaller - larger)).sum())


def borders_of(vectors: DataFrame, chunks: int) -> list[np.ndarray]:
    long = vectors.select(F.posexplode("x").alias("k", "v"))
    shares = [j / chunks for j in range(1, chunks)]
    rows = long.groupBy("k").agg(F.percentile_approx("v", shares, 10 * chunks).alias("q")).orderBy("k").collect()
    return [np.unique(np.asarray(row.q, dtype=float)) for row in rows]


def chunk_numbers(x: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    """Even numbers between borders, odd ones on them."""
    out = np.zeros(x.shape, dtype=np.int32)
    for j, cut in enumerate(borders):
        at = np.searchsorted(cut, x[:, j], side="left")
        out[:, j] = 2 * at + (cut[np.minimum(at, len(cut) - 1)] == x[:, j])
    return out


def sign_products(vectors: DataFrame, sort_rows: int | None = None) -> DataFrame:
    """(a, b, s) over all ordered feature pairs of vectors(x): sums over row pairs of the product of signs."""
    n = vectors.count()
    chunks = min(MOST_CHUNKS, -(-n // (sort_rows or SORT_ROWS))) if n else 1
    borders = borders_of(vectors, chunks) if chunks > 1 else []

    def matrix(batch) -> np.ndarray:
        return batch.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(pa.Table.from_batches([batch]))
                c = chunk_numbers(x, borders) if borders else np.zeros(x.shape, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array(list(c), pa.list_(pa.int32()))], ["x", "c"])

    placed = vectors.select("x").mapInArrow(number, "x array<double>, c array<int>")
    placed = stage(placed) if chunks > 1 else placed

    def inside(key: tuple, table: pa.Table) -> pa.Table:
        f, x = key[0].as_py(), matrix(table)
        c = table.column("c").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(x.shape)
        found = [(f, b, agreement(x[:, f], x[:, b])) for b in range(f + 1, x.shape[1])]
        if chunks > 1:
            found += [(a, f, agreement(c[:, a], x[:, f])) for a in range(f)]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.float64()))], names=["a", "b", "s"])

    each = placed.select("x", "c", F.posexplode("c").alias("f", "chunk")).filter("chunk % 2 = 0")
    parts = each.groupBy("f", "chunk").applyInArrow(inside, SUMS)
    if chunks > 1:

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                c = batch.column("c").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)
                for a in range(c.shape[1]):
                    for b in range(a + 1, c.shape[1]):
                        cell, k = np.unique(c[:, a] << 32 | c[:, b], return_counts=True)
                        ints = [pa.array(v.astype(np.int32), pa.int32()) for v in (np.full(len(cell), a), np.full(len(cell), b), cell >> 32, cell & 0xFFFFFFFF)]
                        yield pa.RecordBatch.from_arrays([*ints, pa.array(k, pa.int64())], ["a", "b", "ca", "cb", "n"])

        cells = placed.select("c").mapInArrow(tally, "a int, b int, ca int, cb int, n long")
        cells = cells.groupBy("a", "b", "ca", "cb").agg(F.sum("n").alias("n"))

        def between(key: tuple, table: pa.Table) -> pa.Table:
            s = grid_agreement(*(table.column(c).to_numpy() for c in ("ca", "cb", "n")))
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([s])], names=["a", "b", "s"])

        parts = parts.unionByName(cells.groupBy("a", "b").applyInArrow(between, SUMS))
    parts = stage(parts.groupBy("a", "b").agg(F.sum("s").alias("s")))
    values = vectors.select(F.posexplode("x").alias("a", "v")).groupBy("a", "v").agg(F.count(F.lit(1)).alias("c"))
    ties = values.groupBy("a").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("t"))
    own = ties.select("a", F.col("a").alias("b"), (F.lit(n * (n - 1) // 2) - F.col("t")).alias("s"))
    return parts.unionByName(parts.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).unionByName(own)
