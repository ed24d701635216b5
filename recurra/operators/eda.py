"""Exploratory summaries: describe, cross tables, histograms, densities, silence."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import half_open_bin
from .chunks import exact_quantiles, next_value


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std (n - 1), min, exact quartiles and max: one row per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value"
    )
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quarters = exact_quantiles(long, "column", "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return moments.join(quarters.drop("n"), "column", "left")


def crosstab(df: DataFrame, row: str, col: str, values: list | None = None) -> DataFrame:
    """Counts of ``col`` per ``row``, absent pairs as zero. Naming the values saves a pass."""
    counts = df.groupBy(row).pivot(col, values) if values else df.groupBy(row).pivot(col)
    return counts.count().na.fill(0)


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of distinct values and whether there is more than one, per column."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value"
    )
    return (
        long.filter("value is not null")
        .groupBy("column", "value")
        .agg(F.lit(1).alias("one"))
        .groupBy("column")
        .agg(F.count("one").alias("n_unique"))
        .withColumn("varies", F.col("n_unique") > 1)
    )


def histogram_by(df: DataFrame, hue: str, value: str, bins: int = 20) -> DataFrame:
    """Counts per (bin, hue) with bins over the range of all rows."""
    data = df.select(hue, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    low = data.agg(F.min("_v")).scalar()
    high = data.agg(F.max("_v")).scalar()
    return (
        data.withColumn("bin", half_open_bin(F.col("_v"), low, high, bins))
        .groupBy("bin", hue)
        .agg(F.count(F.lit(1)).alias("c"))
    )


def density_by(df: DataFrame, hue: str, value: str, points: int = 32) -> DataFrame:
    """Gaussian kernel density per class on a grid over the range of all rows (Scott bandwidth).

    Each row adds its kernel to every grid point before the shuffle, which carries sums only.
    """
    data = df.select(hue, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    low = data.agg(F.min("_v")).scalar()
    high = data.agg(F.max("_v")).scalar()
    scale = data.groupBy(hue).agg(
        F.count(F.lit(1)).alias("n"),
        (F.stddev_samp("_v") * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("h"),
    )
    z = (F.col("_v") - F.col("x")) / F.col("h")
    return (
        data.join(scale, hue)
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", low + (high - low) * F.col("point") / F.lit(points - 1))
        .groupBy(hue, "point")
        .agg(
            F.first("x").alias("x"),
            (F.sum(F.exp(-0.5 * z * z)) / F.first("n") / F.first("h") / math.sqrt(2 * math.pi)).alias(
                "density"
            ),
        )
    )


def silence_intervals(active: DataFrame, lengths: DataFrame, rate: float = 25000.0) -> DataFrame:
    """Complement of the active intervals in [0, n): (signal_id, s, e, start_s, end_s).

    ``active`` is (signal_id, s, e), ``lengths`` is (signal_id, n). Every interval yields the gap
    after it; a sentinel at 0 yields the leading one.
    """
    edges = active.select("signal_id", "s", "e").unionByName(
        lengths.select("signal_id", F.lit(-1).cast("long").alias("s"), F.lit(0).cast("long").alias("e"))
    )
    return (
        next_value(edges, ["signal_id"], "s", "_next")
        .join(lengths.select("signal_id", "n"), "signal_id")
        .select("signal_id", F.col("e").alias("s"), F.coalesce("_next", "n").alias("e"))
        .filter("e > s")
        .withColumn("start_s", F.col("s") / rate)
        .withColumn("end_s", F.col("e") / rate)
    )
