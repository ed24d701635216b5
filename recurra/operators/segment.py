"""Segment selection: activity detection, choice of the analysis window, normalisation."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .blocks import map_rows, signal_blocks
from .chunks import runs_of

RESAMPLE_BLOCK = 4096
FRAME, HOP, TOP_DB = 2048, 512, 30.0
TARGET, EDGE = 25000, 2500
POWER_FLOOR = 1e-10


def mono(samples: DataFrame) -> DataFrame:
    """Mean over the channels: (signal_id, channel, i, n, y) to (signal_id, i, n, y)."""
    return samples.groupBy("signal_id", "i").agg(F.first("n").alias("n"), F.avg("y").alias("y"))


def frame_power(signal: DataFrame, frame: int = FRAME, hop: int = HOP) -> DataFrame:
    """Mean square of centred, zero-padded frames: (signal_id, t, n, power).

    Samples are first summed per hop; a frame is the sum of its hops.
    """
    half = frame // (2 * hop)
    hops = signal.groupBy("signal_id", F.floor(F.col("i") / hop).alias("k")).agg(
        F.sum(F.col("y") * F.col("y")).alias("e"), F.first("n").alias("n")
    )
    first = F.greatest(F.col("k") - half + 1, F.lit(0))
    last = F.least(F.col("k") + half, F.floor(F.col("n") / hop))
    return (
        hops.filter(first <= last)
        .withColumn("t", F.explode(F.sequence(first, last)))
        .groupBy("signal_id", "t")
        .agg(F.first("n").alias("n"), (F.sum("e") / frame).alias("power"))
    )


def active_intervals(
    signal: DataFrame, top_db: float = TOP_DB, frame: int = FRAME, hop: int = HOP
) -> DataFrame:
    """Half-open sample intervals within ``top_db`` of the loudest frame: (signal_id, s, e)."""
    power = frame_power(signal, frame, hop)
    loudest = power.groupBy("signal_id").agg(F.max("power").alias("peak"))
    decibel = 10 * F.log10(F.greatest("power", F.lit(POWER_FLOOR))) - 10 * F.log10(
        F.greatest("peak", F.lit(POWER_FLOOR))
    )
    loud = power.join(loudest, "signal_id").filter(decibel > -top_db)
    length = signal.groupBy("signal_id").agg(F.first("n").alias("n"))
    return (
        runs_of(loud, ["signal_id"], "t")
        .join(length, "signal_id")
        .select(
            "signal_id",
            (F.col("s") * hop).alias("s"),
            F.least(F.col("e") * hop, F.col("n")).alias("e"),
        )
    )


def longest_interval(active: DataFrame) -> DataFrame:
    """The longest interval per signal, the first on ties."""
    best = F.max(F.struct((F.col("e") - F.col("s")).alias("len"), (-F.col("s")).alias("at")))
    return (
        active.groupBy("signal_id")
        .agg(best.alias("b"))
        .select("signal_id", (-F.col("b.at")).alias("s"), (F.col("b.len") - F.col("b.at")).alias("e"))
    )


def choose_window(
    signal: DataFrame, longest: DataFrame, target: int = TARGET, edge: int = EDGE
) -> DataFrame:
    """The samples to keep, [lo, hi), and the zeros to append: (signal_id, n, lo, hi, pad, case)."""
    length = signal.groupBy("signal_id").agg(F.first("n").alias("n"))
    spans = length.join(longest, "signal_id", "left")
    sides = signal.join(longest, "signal_id").filter("i >= s AND i < e")
    square = F.col("y") * F.col("y")
    energy = sides.groupBy("signal_id").agg(
        F.sum(F.when(F.col("i") < F.col("s") + edge, square)).alias("head"),
        F.sum(F.when(F.col("i") >= F.col("e") - edge, square)).alias("tail"),
    )
    size = F.col("e") - F.col("s")
    need = F.lit(target) - size
    before0 = F.least(F.col("s"), F.floor(need / 2))
    after = F.least(F.col("n") - F.col("e"), need - before0)
    before = before0 + F.least(F.col("s") - before0, need - before0 - after)
    case = (
        F.when(F.col("n") < target, "short")
        .when(F.col("s").isNull(), "silent")
        .when(size >= target, "trim")
        .otherwise("extend")
    )
    late = F.col("head") < F.col("tail")
    lo = (
        F.when(F.col("case").isin("short", "silent"), F.lit(0))
        .when(F.col("case") == "extend", F.col("s") - before)
        .when(late, F.col("e") - target)
        .otherwise(F.col("s"))
    )
    hi = (
        F.when(F.col("case") == "short", F.col("n"))
        .when(F.col("case") == "silent", F.lit(target))
        .when(F.col("case") == "extend", F.col("e") + after)
        .when(late, F.col("e"))
        .otherwise(F.col("s") + target)
    )
    return (
        spans.join(energy, "signal_id", "left")
        .withColumn("case", case)
        .select(
            "signal_id",
            "n",
            lo.cast("long").alias("lo"),
            hi.cast("long").alias("hi"),
            F.greatest(F.lit(target) - F.col("n"), F.lit(0)).cast("long").alias("pad"),
            "case",
        )
    )


def cut_segment(signal: DataFrame, window: DataFrame) -> DataFrame:
    """Samples of the chosen window, renumbered from 0, followed by the appended zeros."""
    bounds = window.select("signal_id", "lo", "hi", "pad")
    kept = (
        signal.join(bounds, "signal_id")
        .filter("i >= lo AND i < hi")
        .select("signal_id", (F.col("i") - F.col("lo")).alias("i"), (F.col("hi") - F.col("lo") + F.col("pad")).alias("n"), "y")
    )
    size = F.col("hi") - F.col("lo")
    zeros = bounds.filter("pad > 0").select(
        "signal_id",
        F.explode(F.sequence(size, size + F.col("pad") - 1)).alias("i"),
        (size + F.col("pad")).alias("n"),
        F.lit(0.0).alias("y"),
    )
    return kept.unionByName(zeros)


def peak_normalize(signal: DataFrame) -> DataFrame:
    """Divide by the largest magnitude; a zero signal stays as it is."""
    peak = signal.groupBy("signal_id").agg(F.max(F.abs("y")).alias("peak"))
    scaled = F.when(F.col("peak") > 0, F.col("y") / F.col("peak")).otherwise(F.col("y"))
    return signal.join(peak, "signal_id").select("signal_id", "i", "n", scaled.alias("y"))


def quantize_pcm16(signal: DataFrame) -> DataFrame:
    """The 16-bit rounding a written and re-read audio file goes through."""
    code = F.greatest(F.least(F.rint(F.col("y") * 32767.0), F.lit(32767.0)), F.lit(-32768.0))
    return signal.select("signal_id", "i", "n", code.cast("int").alias("pcm"), (code / 32768.0).alias("y"))


def preprocess(
    signal: DataFrame,
    target: int = TARGET,
    edge: int = EDGE,
    top_db: float = TOP_DB,
    frame: int = FRAME,
    hop: int = HOP,
) -> DataFrame:
    """Activity detection to normalised segment of exactly ``target`` samples.

    The interval, the bounds (one row per signal each) and the cut are staged on the way.
    """
    longest = stage(longest_interval(active_intervals(signal, top_db, frame, hop)))
    window = stage(choose_window(signal, longest, target, edge))
    return peak_normalize(stage(cut_segment(signal, window)))


def resample(
    signal: DataFrame, target_rate: int = 25000, zero_crossings: int = 32, size: int = RESAMPLE_BLOCK
) -> DataFrame:
    """Windowed-sinc resampling of (signal_id, i, n, y, sr) to (signal_id, i, n, y) at the target rate.

    Works on blocks with as much halo as the filter reaches, output positions counted from the start of the series,
    so no block shows in the result. With rates in the ratio down : up, outputs have at most ``up`` distances to the
    sample before them; the filter of each is computed once a task and applied to all its outputs in one product.
    Signals at the target rate pass through. The filter is a Hann-windowed sinc, so results agree with other
    band-limited resamplers only approximately.
    """
    found = signal.filter(F.col("sr") == target_rate).select("signal_id", "i", "n", "y")
    rates = [row.sr for row in signal.select("sr").distinct().collect() if row.sr != target_rate]  # a handful
    for rate in sorted(rates):
        found = found.unionByName(_resample_from(signal.filter(F.col("sr") == rate), rate, target_rate, zero_crossings, size))
    return found


def _resample_from(signal: DataFrame, rate: int, target_rate: int, zero_crossings: int, size: int) -> DataFrame:
    cutoff = min(1.0, target_rate / rate)
    reach = math.ceil(zero_crossings / cutoff)
    common = math.gcd(rate, target_rate)
    up, down = target_rate // common, rate // common

    def kernel(row):
        low, high = row.b * size, min((row.b + 1) * size, row.n)
        first, last = -(-low * target_rate // rate), -(-high * target_rate // rate)
        # From y[low - reach + 1] on, zeros where the series has no samples; an output's taps are one run of them.
        padded = np.zeros(high - low + 2 * reach)
        begin = row.start - (low - reach + 1)
        padded[begin : begin + len(row.y)] = row.y
        taps = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach)
        total = np.zeros(last - first)
        for k in range(min(up, last - first)):
            at = (first + k) * down
            own = total[k::up]
            start = at // up - low
            runs = taps[start : start + (len(own) - 1) * down + 1 : down]
            own[:] = runs @ _phase_filter(at % up, up, cutoff, reach)
        return {"i": np.arange(first, last), "n": np.full(last - first, -(-row.n * target_rate // rate)), "y": total}

    blocks = signal_blocks(signal, size, reach - 1, reach)
    return map_rows(blocks, "signal_id", "i long, n long, y double", kernel)


@lru_cache(maxsize=8192)
def _phase_filter(phase: int, up: int, cutoff: float, reach: int) -> np.ndarray:
    """Weights of the samples -reach + 1 .. reach for an output that lies phase / up behind sample 0."""
    gap = phase / up - np.arange(-reach + 1, reach + 1)
    return cutoff * np.sinc(cutoff * gap) * (0.5 + 0.5 * np.cos(np.pi * gap / reach))


def resample_arrays(arrays: DataFrame, target_rate: int = 25000, zero_crossings: int = 32) -> DataFrame:
    """Resample files given as rows (signal_id, sr, y array), as audio decoding returns them."""
    long = arrays.select(
        "signal_id", F.size("y").cast("long").alias("n"), F.col("sr").alias("sr"), F.posexplode("y").alias("i", "y")
    )
    return resample(long.withColumn("i", F.col("i").cast("long")), target_rate, zero_crossings)


def outcome_counts(status: DataFrame, column: str = "status") -> DataFrame:
    """Processed and skipped inputs."""
    return status.groupBy(column).agg(F.count(F.lit(1)).alias("c"))


