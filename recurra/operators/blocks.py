"""Signals and point pairs as bounded blocks: the unit of dense NumPy work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import chunk_with_halo

BLOCK = 1024


def spread(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Hash-partition by the keys over all shuffle partitions, or over ``tasks``.

    Kernels cost far more per byte than AQE assumes when it merges small partitions; a partition
    count given explicitly is left alone, and the following join or grouping reuses the exchange.
    """
    return df.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def signal_blocks(
    signal: DataFrame,
    size: int = BLOCK,
    before: int = 0,
    after: int = 0,
    points_lost: int = 0,
    reverse: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """(signal_id, b, n, start, y): samples of each block plus a halo.

    Blocks cover the ``n - points_lost`` positions that start a delay vector. ``reverse`` reads
    the series backwards, which is what a vertically flipped recurrence image needs for its rows.
    A series of at most ``points_lost`` samples has no delay vector and so gives no block and no row.
    """
    pos = F.col("n") - 1 - F.col("i") if reverse else F.col("i")
    rows = signal.select("signal_id", "n", pos.cast("long").alias("p"), "y").filter(
        F.col("n") > points_lost
    )
    copied = chunk_with_halo(rows, "p", size, before, after).filter(
        F.col("b") * size < F.col("n") - points_lost
    )
    return (
        spread(copied.select("signal_id", "b", "n", "p", "y"), "signal_id", "b", tasks=tasks)
        .groupBy("signal_id", "b")
        .agg(
            F.first("n").alias("n"),
            F.min("p").alias("start"),
            F.array_sort(F.collect_list(F.struct("p", "y"))).alias("_s"),
        )
        .select("signal_id", "b", "n", "start", F.col("_s.y").alias("y"))
    )


def block_pairs(
    rows: DataFrame,
    cols: DataFrame,
    size: int,
    points_lost: int,
    upper: bool,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per tile of the point-by-point matrix: (signal_id, n, br, bc, r_*, c_*).

    Each block is copied along its row or column of the tile grid and the two copies meet in an
    equi-join, so the pairs of one signal spread over all tasks. ``upper`` keeps br <= bc.
    """
    last = (F.ceil((F.col("n") - points_lost) / size) - 1).cast("long")
    zero = F.lit(0).cast("long")
    left = rows.select(
        "signal_id",
        "n",
        *(carry or []),
        F.col("b").alias("br"),
        F.explode(F.sequence(F.col("b") if upper else zero, last)).alias("bc"),
        F.col("start").alias("r_start"),
        F.col("y").alias("r_y"),
    )
    right = cols.select(
        "signal_id",
        F.explode(F.sequence(zero, F.col("b") if upper else last)).alias("br"),
        F.col("b").alias("bc"),
        F.col("start").alias("c_start"),
        F.col("y").alias("c_y"),
    )
    keys = ["signal_id", "br", "bc"]
    return spread(left, *keys).join(spread(right, *keys), keys)


HELD = 1 << 22  # values and bytes of results that a task keeps before it emits them


def _weight(part) -> int:
    """Values and bytes of a result column; a list may hold arrays and binaries."""
    if isinstance(part, np.ndarray):
        return part.size
    return sum(len(v) if isinstance(v, (bytes, list, np.ndarray)) else 1 for v in part)


def map_rows(
    df: DataFrame,
    key: str,
    schema: str,
    kernel: Callable[..., dict[str, np.ndarray] | None],
) -> DataFrame:
    """Apply a NumPy kernel to every row (a block or a tile); output rows carry the key column.

    The kernel gets the row as a named tuple and returns equal-length arrays per output column. Results leave the task
    as soon as they are ``HELD`` values and bytes, however many rows a batch holds.
    """
    out = T.StructType([df.schema[key]] + T._parse_datatype_string(schema).fields)
    names = [f.name for f in out.fields]

    def table(keys: list, sizes: list, columns: dict) -> pd.DataFrame:
        found = {key: np.repeat(np.asarray(keys, dtype=object), sizes)}
        for name, values in columns.items():
            found[name] = (
                values[0]
                if len(values) == 1
                else np.concatenate(values)
                if isinstance(values[0], np.ndarray)
                else [item for part in values for item in part]
            )
        return pd.DataFrame(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, sizes, held, columns = [], [], 0, {name: [] for name in names[1:]}
            for row in pdf.itertuples(index=False):
                found = kernel(row)
                if found is None:
                    continue
                for name, values in columns.items():
                    values.append(found[name])
                keys.append(getattr(row, key))
                sizes.append(len(found[names[-1]]))
                held += sum(map(_weight, found.values()))
                if held >= HELD:
                    yield table(keys, sizes, columns)
                    keys, sizes, held, columns = [], [], 0, {name: [] for name in names[1:]}
            if sum(sizes):
                yield table(keys, sizes, columns)

    return df.mapInPandas(run, out)


def delay_vectors(y: np.ndarray, m: int, tau: int, backwards: bool = False) -> np.ndarray:
    """Coordinates (m, points) of the delay embedding of a sample block."""
    count = len(y) - (m - 1) * tau
    coords = [y[k * tau : k * tau + count] for k in range(m)]
    return np.stack(coords[::-1] if backwards else coords)


STRIP = 128


def pair_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances between two sets of points given as (m, points).

    Coordinate differences are squared and summed directly, strip by strip so that the working set
    stays in the processor's cache.
    """
    total = np.zeros((p.shape[1], q.shape[1]))
    step = np.empty((STRIP, q.shape[1]))
    for top in range(0, p.shape[1], STRIP):
        part = total[top : top + STRIP]
        work = step[: len(part)]
        for a, b in zip(p, q):
            np.subtract(a[top : top + STRIP, None], b, out=work)
            np.multiply(work, work, out=work)
            part += work
        np.sqrt(part, out=part)
    return total
