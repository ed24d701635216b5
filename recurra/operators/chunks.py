"""Skew-safe building blocks: long groups are cut into bounded chunks and merged again.

Nothing here gathers a whole group in one task: ranks, runs and quantiles are computed per chunk,
and only the per-chunk summaries meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lerp
from ..session import stage

QUANTILE_BINS = 4096
TASK_ROWS = 1 << 18  # rows of a series table that one task orders or groups


def more_tasks(df: DataFrame, rows: int) -> int | None:
    """Partitions that hold at most ``TASK_ROWS`` of so many rows; None where the session's number does."""
    tasks = -(-rows // TASK_ROWS)
    return tasks if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Hash-partition by the keys over ``tasks``; without a number, Spark deals them out where it needs to."""
    return df if tasks is None else df.repartition(tasks, *keys)


def hour_chunk(ts: str, hours: int = 1) -> Column:
    """Monotone chunk number of a timestamp, independent of the session time zone for NTZ input."""
    return F.floor((F.unix_date(F.to_date(ts)) * 24 + F.hour(ts)) / F.lit(hours))


def range_chunks(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Add ``_range``, a chunk number that never falls in the order of each key's rows.

    Chunks are the ranges of a range partitioning, whose borders Spark takes from a sample of the rows: they hold about
    equally many rows however far apart the values lie. The result is written, so the numbers stay when tasks repeat.
    """
    return stage(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))


def ordered_index(df: DataFrame, key: str, order_by: list[str], chunk: Column, tasks: int | None = None) -> DataFrame:
    """Add ``i`` (0-based position in the key's order) and ``n`` (length of the key).

    ``chunk`` must be non-decreasing in the order. Rows are ranked inside (key, chunk), and the
    chunk counts give the offsets, so a hot key spreads over as many tasks as it has chunks.
    """
    base = dealt(df.withColumn("_chunk", chunk), tasks, key, "_chunk")
    by_chunk = Window.partitionBy(key).orderBy("_chunk")
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    counts = base.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_c"))
    offsets = (
        dealt(counts, tasks, key)
        .withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .withColumn("n", F.sum("_c").over(Window.partitionBy(key)))
        .drop("_c")
    )
    inside = Window.partitionBy(key, "_chunk").orderBy(*order_by)
    return (
        base.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(offsets, [key, "_chunk"])
        .withColumn("i", F.col("_off") + F.col("_rn"))
        .drop("_chunk", "_rn", "_off")
    )


def running_totals(
    df: DataFrame, key: list[str], order_by: list, sums: dict[str, Column], chunk: Column
) -> DataFrame:
    """Inclusive running sums in the key's order, added chunk by chunk.

    ``chunk`` must be non-decreasing in the order; chunk totals give the offsets.
    """
    base = df.withColumn("_chunk", chunk)
    for name, value in sums.items():
        base = base.withColumn(f"_v_{name}", value)
    before = (
        Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = base.groupBy(*key, "_chunk").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    )
    offsets = totals.select(
        *key,
        "_chunk",
        *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums],
    )
    inside = (
        Window.partitionBy(*key, "_chunk")
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = base
    for name in sums:
        out = out.withColumn(f"_r_{name}", F.sum(f"_v_{name}").over(inside))
    out = out.join(offsets, [*key, "_chunk"])
    for name in sums:
        out = out.withColumn(name, F.col(f"_r_{name}") + F.col(f"_o_{name}"))
    return out.drop("_chunk", *[f"_{t}_{name}" for name in sums for t in "vro"])


def next_value(df: DataFrame, keys: list[str], pos: str, name: str, chunk: int = 65536) -> DataFrame:
    """Add ``name``: the next larger ``pos`` of the same keys, NULL at the end.

    Positions are ordered inside chunks; each chunk's last row takes the first position of the next
    chunk that has any.
    """
    base = df.withColumn("_c", F.floor(F.col(pos) / chunk))
    firsts = base.groupBy(*keys, "_c").agg(F.min(pos).alias("_first"))
    after = F.lead("_first").over(Window.partitionBy(*keys).orderBy("_c"))
    inside = F.lead(pos).over(Window.partitionBy(*keys, "_c").orderBy(pos))
    return (
        base.withColumn("_in", inside)
        .join(firsts.withColumn("_after", after).drop("_first"), [*keys, "_c"])
        .withColumn(name, F.coalesce("_in", "_after"))
        .drop("_c", "_in", "_after")
    )


def chunk_with_halo(df: DataFrame, pos: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Assign rows to chunks of ``size`` positions, copying the rows a neighbour needs.

    Adds ``b`` (chunk) and ``own`` (false for the copied halo rows).
    """
    first = F.greatest(F.lit(0), F.floor((F.col(pos) - after) / size))
    last = F.floor((F.col(pos) + before) / size)
    return df.withColumn("b", F.explode(F.sequence(first, last))).withColumn(
        "own", F.floor(F.col(pos) / size) == F.col("b")
    )


def merge_runs(segments: DataFrame, keys: list[str], chunk: int, start="s", end="e") -> DataFrame:
    """Join half-open segments that meet at a chunk border; the others pass through.

    Only border-touching segments (two per chunk at most) share a window partition.
    """
    touching = (F.col(start) % chunk == 0) | (F.col(end) % chunk == 0)
    part = F.when(touching, F.lit(-1)).otherwise(F.floor(F.col(start) / chunk))
    w = Window.partitionBy(*keys, "_part").orderBy(start)
    fresh = F.coalesce((F.col(start) != F.lag(end).over(w)).cast("int"), F.lit(1))
    return (
        segments.withColumn("_part", part)
        .withColumn("_new", fresh)
        .withColumn("_gid", F.sum("_new").over(w))
        .groupBy(*keys, "_part", "_gid")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_part", "_gid")
    )


def runs_of(df: DataFrame, keys: list[str], pos: str, chunk: int = 65536) -> DataFrame:
    """Gaps and islands: maximal runs [s, e) of consecutive positions present in ``df``."""
    w = Window.partitionBy(*keys, "_c").orderBy("_p")
    pieces = (
        df.select(*keys, F.col(pos).cast("long").alias("_p"))
        .withColumn("_c", F.floor(F.col("_p") / chunk))
        .withColumn("_g", F.col("_p") - F.row_number().over(w))
        .groupBy(*keys, "_c", "_g")
        .agg(F.min("_p").alias("s"), (F.max("_p") + 1).alias("e"))
        .drop("_c", "_g")
    )
    return merge_runs(pieces, keys, chunk)


def _names(group: str | list[str]) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def exact_quantiles(df: DataFrame, group: str, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group in bounded memory.

    A histogram per group locates the bins holding the wanted ranks; only distinct values inside
    those bins are then ordered. Output: group, n and one column per entry of ``probs``.
    """
    data = df.select(group, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    span = data.groupBy(group).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("n")
    )
    raw = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * QUANTILE_BINS)
    binned = data.join(span, group).withColumn(
        "_bin",
        F.when(F.col("_hi") > F.col("_lo"), F.least(raw, F.lit(QUANTILE_BINS - 1))).otherwise(0),
    )
    counts = binned.groupBy(group, "_bin").agg(
        F.count(F.lit(1)).alias("_c"), F.first("n").alias("n")
    )
    # The bins that hold a wanted rank are cut once more, so that one far value does not leave all others in one bin.
    first = wanted_bins(counts, group, probs).withColumnRenamed("_before", "_base")
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * QUANTILE_BINS - F.col("_bin")
    within = F.greatest(F.lit(0), F.least(F.floor(share * QUANTILE_BINS), F.lit(QUANTILE_BINS - 1)))
    split = (
        binned.select(group, "_bin", "_v", F.when(F.col("_hi") > F.col("_lo"), within).otherwise(0).alias("_sub"))
        .join(first, [group, "_bin"])
        .withColumn("_bin", F.col("_bin") * QUANTILE_BINS + F.col("_sub"))
    )
    parts = split.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_c"), F.first("n").alias("n"), F.first("_base").alias("_base"))
    wanted = wanted_bins(parts, group, probs, base="_base")
    inside = (
        split.select(group, "_bin", "_v")
        .join(wanted, [group, "_bin"])
        .groupBy(group, "_bin", "_v", "_before", "n")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    return quantiles_inside(inside, group, probs)


def _ranks(probs: dict[str, float]) -> dict[str, tuple[Column, Column, Column]]:
    out = {}
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(float(p))
        out[name] = (F.floor(h), F.ceil(h), h - F.floor(h))
    return out


def wanted_bins(counts: DataFrame, group: str | list[str], probs: dict[str, float], base: str | None = None) -> DataFrame:
    """Bins that hold a wanted rank: (group, _bin, _before, n) from (group, _bin, _c, n).

    Bins of equal ``base`` are parts of one larger bin, before which as many rows stand.
    """
    more = [] if base is None else [base]
    w = Window.partitionBy(*_names(group), *more).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    start = F.lit(0) if base is None else F.col(base)
    cum = counts.withColumn("_cum", start + F.sum("_c").over(w)).withColumn("_before", F.col("_cum") - F.col("_c"))
    hit = F.lit(False)
    for low, high, _ in _ranks(probs).values():
        for rank in (low, high):
            hit = hit | ((F.col("_before") <= rank) & (F.col("_cum") > rank))
    return cum.filter(hit).select(*_names(group), "_bin", "_before", "n")


def quantiles_inside(inside: DataFrame, group: str | list[str], probs: dict[str, float]) -> DataFrame:
    """Finish from distinct values of the wanted bins: (group, _bin, _v, _c, _before, n)."""
    w = Window.partitionBy(*_names(group), "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cum = inside.withColumn("_cum", F.col("_before") + F.sum("_c").over(w))
    picks = []
    for name, (low, high, _) in _ranks(probs).items():
        for tag, rank in (("lo", low), ("hi", high)):
            picks.append(F.min(F.when(F.col("_cum") > rank, F.col("_v"))).alias(f"_{name}_{tag}"))
    out = cum.groupBy(*_names(group)).agg(F.first("n").alias("n"), *picks)
    cols = [
        lerp(F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), weight).alias(name)
        for name, (_, _, weight) in _ranks(probs).items()
    ]
    return out.select(*_names(group), "n", *cols)
