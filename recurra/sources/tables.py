"""Adapters from ordinary tables to signals and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunks import hour_chunk, more_tasks, ordered_index, range_chunks


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def signal_from_events(
    events: DataFrame,
    key: str = "user_id",
    ts: str = "ts",
    tiebreak: str = "event_id",
    value: str = "value",
    hours: int | None = 1,
) -> DataFrame:
    """Time series in long form: (signal_id, i, n, y).

    Positions are counted per chunk of ``hours`` hours; without a number, per range of about equally many rows, for
    series that put most of their samples into a few hours.
    """
    rows = events.select(
        F.col(key).alias("signal_id"), ts, tiebreak, F.col(value).cast("double").alias("y")
    ).filter("y is not null")
    if hours is None:
        rows, chunk = range_chunks(rows, ["signal_id"], [ts, tiebreak]), F.col("_range")
    else:
        chunk = hour_chunk(ts, hours)
    tasks = more_tasks(events, events.count()) if hours is not None else None
    return ordered_index(rows, "signal_id", [ts, tiebreak], chunk, tasks).select(
        "signal_id", "i", "n", "y"
    )


def signal_from_arrays(df: DataFrame, key: str, values: str) -> DataFrame:
    """Long form of one-array-per-signal input (decoded audio files)."""
    return df.select(
        F.col(key).alias("signal_id"),
        F.size(values).cast("long").alias("n"),
        F.posexplode(values).alias("i", "y"),
    ).select("signal_id", F.col("i").cast("long").alias("i"), "n", F.col("y").cast("double").alias("y"))


def vector_features(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Long feature table (row_id, label, feature, value) from an array column."""
    return df.select(
        F.col(key).alias("row_id"),
        F.col(label).alias("label"),
        F.posexplode(vector).alias("feature", "value"),
    ).withColumn("value", F.col("value").cast("double"))


def wide_features(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Unpivot a wide feature table to (keys, feature, value); feature columns are all but the keys."""
    columns = columns or [c for c in df.columns if c not in keys]
    typed = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return typed.unpivot(keys, columns, "feature", "value")
