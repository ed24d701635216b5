"""Bookkeeping of feature extraction: validation, manifests, missing work, combination, progress."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import chunk_with_halo, running_totals

# --- image and feature checks ------------------------------------------------------------------


def to_gray(channels: list[Column]) -> Column:
    """Mean of the colour channels, truncated as an integer pixel."""
    return F.floor(sum(channels[1:], channels[0]) / len(channels)).cast("int")


def size_filter(images: DataFrame, smallest: int = 2000) -> DataFrame:
    return images.filter((F.col("h") >= smallest) & (F.col("w") >= smallest))


def rescale_shape(h: Column, w: Column, largest: int = 25000) -> Column:
    """Height and width after shrinking an image to fit the limit, proportions kept."""
    scale = F.least(F.lit(largest) / w, F.lit(largest) / h, F.lit(1.0))
    return F.struct(
        F.floor(h * scale).cast("int").alias("h"), F.floor(w * scale).cast("int").alias("w")
    )


def normalize_range(pixels: DataFrame, key: str, value: str) -> DataFrame:
    """Min-max scale a group's values to [0, 255], but only where they leave that range."""
    span = pixels.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    outside = (F.col("_lo") < 0) | (F.col("_hi") > 255)
    scaled = F.when(
        F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255
    ).otherwise(F.lit(0.0))
    return (
        pixels.join(span, key)
        .withColumn(value, F.when(outside, scaled).otherwise(F.col(value)))
        .withColumn("uniform", F.col("_lo") == F.col("_hi"))
        .drop("_lo", "_hi")
    )


def to_uint8(value: Column) -> Column:
    """Clip to 0..255 and truncate."""
    return F.greatest(F.least(F.floor(value), F.lit(255)), F.lit(0)).cast("int")


def stretch_to_uint8(pixels: DataFrame, key: str, value: str) -> DataFrame:
    """Non-integer images: times 255 when they stay within [0, 1], else min-max to 0..255."""
    span = pixels.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    unit = (F.col("_lo") >= 0) & (F.col("_hi") <= 1)
    wide = F.when(
        F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255
    ).otherwise(F.lit(0.0))
    return (
        pixels.join(span, key)
        .withColumn(value, to_uint8(F.when(unit, F.col(value) * 255).otherwise(wide)))
        .drop("_lo", "_hi")
    )


def load_stats(loads: DataFrame, status: str = "status") -> DataFrame:
    """Counts and rates of a load: (total, loaded, failed, success_rate)."""
    ok = F.sum((F.col(status) == "ok").cast("long"))
    total = F.count(F.lit(1))
    return loads.agg(
        total.alias("total"), ok.alias("loaded"), (total - ok).alias("failed"), (ok / total).alias("success_rate")
    )


def fail_after(loads: DataFrame, most: int = 10, status: str = "status") -> DataFrame:
    """Pass the rows on, but fail the query once more than ``most`` loads have failed."""
    failed = loads.agg(F.sum((F.col(status) != "ok").cast("long"))).scalar()
    guard = F.when(failed > most, F.raise_error(F.lit("too many failed images")).cast("boolean")).otherwise(F.lit(True))
    return loads.filter(guard)


def validate_features(features: DataFrame, expected: list[str]) -> DataFrame:
    """Add ``valid``: every expected column present, numeric and finite. Missing names raise."""
    lost = sorted(set(expected) - set(features.columns))
    if lost:
        raise ValueError(f"missing features: {', '.join(lost)}")
    good = F.lit(True)
    for name in expected:
        value = F.col(f"`{name}`").cast("double")
        good = good & value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return features.withColumn("valid", good)


# --- manifests and missing work ----------------------------------------------------------------


def config_hash(config: dict, length: int | None = 8) -> str:
    """md5 of the sorted JSON of a configuration."""
    digest = hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()
    return digest[:length] if length else digest


def hash_columns(columns: list[str], length: int = 8) -> Column:
    """The same idea for rows: md5 of the JSON of the named columns."""
    return F.substring(F.md5(F.to_json(F.struct(*sorted(columns)))), 1, length)


def missing_work(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs without a result yet."""
    return inputs.join(done.select(*keys), keys, "left_anti")


def pending_images(images: DataFrame, computed: DataFrame, descriptor: str, digest: str) -> DataFrame:
    """Images to compute for a descriptor: all of them after a change of configuration.

    ``computed`` is (filename, descriptor, config_hash): results under another hash do not count.
    """
    current = computed.filter((F.col("descriptor") == descriptor) & (F.col("config_hash") == digest))
    return missing_work(images, current, ["filename"])


def only_missing(images: DataFrame, listed: DataFrame, key: str = "filename") -> DataFrame:
    return images.join(listed.select(key), key, "left_semi")


def append_rows(table: DataFrame, extra: DataFrame) -> DataFrame:
    return table.unionByName(extra, allowMissingColumns=True)


def combine(tables: list[DataFrame], key: str = "filename", label: str = "label") -> DataFrame:
    """Inner join of descriptor tables; the label comes from the first."""
    first, *rest = tables
    return reduce(lambda left, right: left.join(right.drop(label), key), rest, first)


def manifest(computed: DataFrame) -> DataFrame:
    """(descriptor, config_hash, total_images, last_update) of everything computed."""
    return computed.groupBy("descriptor", "config_hash").agg(
        F.countDistinct("filename").alias("total_images"), F.max("computed_at").alias("last_update")
    )


def outdated_descriptors(entries: DataFrame) -> DataFrame:
    """Descriptors with fewer images than the fullest one. One row per descriptor."""
    most = entries.agg(F.max("total_images")).scalar()
    return entries.withColumn("missing", most - F.col("total_images")).filter("missing > 0")


def newest(files: DataFrame, group: str, when: str, keep: int = 3) -> DataFrame:
    """The ``keep`` latest entries per group (rotation keeps these).

    A bounded top list per group and chunk comes first, so no task orders a whole group.
    """
    salt = F.pmod(F.xxhash64(*[c for c in files.columns]), F.lit(64))
    names = [when, *[c for c in files.columns if c not in (when, group)]]
    order = [F.col(c).desc() for c in names]
    partial = Window.partitionBy(group, "_salt").orderBy(*order)
    final = Window.partitionBy(group).orderBy(*order)
    return (
        files.withColumn("_salt", salt)
        .withColumn("_r", F.row_number().over(partial))
        .filter(F.col("_r") <= keep)
        .withColumn("_r", F.row_number().over(final))
        .filter(F.col("_r") <= keep)
        .withColumnRenamed("_r", "position")
        .drop("_salt")
    )


# --- progress ----------------------------------------------------------------------------------


def moving_speed(progress: DataFrame, points: int = 10, size: int = 4096) -> DataFrame:
    """Speed over the last ``points`` reports: (signal_id, i, speed).

    Input (signal_id, i, processed, at) with ``i`` the position and ``at`` in seconds. Chunks carry
    the preceding reports as a halo.
    """
    back = points - 1
    w = Window.partitionBy("signal_id", "b").orderBy("i").rowsBetween(-back, 0)
    first = F.first(F.struct("processed", "at")).over(w)
    gap = F.col("at") - F.col("_f.at")
    return (
        chunk_with_halo(progress, "i", size, before=back)
        .withColumn("_f", first)
        .filter("own")
        .select(
            "signal_id",
            "i",
            F.when(gap > 0, (F.col("processed") - F.col("_f.processed")) / gap)
            .otherwise(F.lit(0.0))
            .alias("speed"),
        )
    )


def smoothed_speed(progress: DataFrame, keep: float = 0.3, size: int = 4096) -> DataFrame:
    """Exponentially smoothed speed, two decimals per step: (signal_id, i, speed).

    0 when the progress falls back, held when it stands still, 0.3 * previous + 0.7 * current
    otherwise. A fall-back forgets the past, so a series splits there into independent pieces; a
    piece is folded in order while it streams through a task.
    """
    w = Window.partitionBy("signal_id", "b").orderBy("i")
    steps = (
        chunk_with_halo(progress, "i", size, before=1)
        .withColumn("dp", F.col("processed") - F.lag("processed").over(w))
        .withColumn("dt", F.col("at") - F.lag("at").over(w))
        .filter("own")
        .withColumn(
            "move",
            F.when(F.col("dp").isNull() | (F.col("processed") <= 0), "reset")
            .when((F.col("dt") > 0) & (F.col("dp") > 0), "step")
            .when(F.col("dp") == 0, "hold")
            .otherwise("reset"),
        )
        .select("signal_id", "i", "move", (F.col("dp") / F.col("dt")).alias("now"))
    )
    pieces = running_totals(
        steps,
        ["signal_id"],
        ["i"],
        {"piece": (F.col("move") == "reset").cast("long")},
        F.floor(F.col("i") / size),
    )
    out = T.StructType([pieces.schema["signal_id"], pieces.schema["i"]]).add("speed", T.DoubleType())

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, speed = None, 0.0
        for pdf in batches:
            values = []
            for key, part, move, now in zip(pdf["signal_id"], pdf["piece"], pdf["move"], pdf["now"]):
                if (key, part) != piece:
                    piece, speed = (key, part), 0.0
                if move == "reset":
                    speed = 0.0
                elif move == "step":
                    speed = round(keep * speed + (1 - keep) * now if speed > 0 else now, 2)
                values.append(speed)
            yield pdf[["signal_id", "i"]].assign(speed=values)

    return (
        pieces.repartition("signal_id", "piece")
        .sortWithinPartitions("signal_id", "piece", "i")
        .mapInPandas(fold, out)
    )


# Fixed value: text shown while no estimate exists.
NO_ETA = "Calculando..."


def eta(processed: Column, total: Column, speed: Column) -> Column:
    """Remaining seconds and a readable form; NULL without speed."""
    left = F.when(speed > 0, (total - processed) / speed)
    text = (
        F.when(left.isNull() | (left <= 0), NO_ETA)
        .when(left >= 3600, F.format_string("%dh %dm", F.floor(left / 3600), F.floor(left % 3600 / 60)))
        .when(left >= 60, F.format_string("%dm %ds", F.floor(left / 60), F.floor(left % 60)))
        .otherwise(F.format_string("%ds", F.floor(left)))
    )
    percent = F.when(total > 0, processed / total * 100).otherwise(F.lit(0.0))
    return F.struct(left.alias("seconds"), text.alias("text"), percent.alias("percent"))


def fresh(records: DataFrame, when: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Drop records older than the time to live."""
    return records.filter((now.cast("timestamp").cast("double") - F.col(when).cast("timestamp").cast("double")) <= ttl_seconds)
