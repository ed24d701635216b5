"""Two-dimensional wavelet decomposition of image tiles and its subband features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import entropy_term, safe_div
from ..session import stage
from .blocks import map_rows
from .recurrence import pixels

# Low-pass decomposition taps.
LOW_PASS = {
    "haar": (0.7071067811865476, 0.7071067811865476),
    "db4": (
        -0.010597401785069032,
        0.0328830116668852,
        0.030841381835560764,
        -0.18703481171909309,
        -0.027983769416859854,
        0.6308807679298589,
        0.7148465705529157,
        0.2303778133088965,
    ),
}

ENTROPY_BINS = 64


def filters(wavelet: str) -> tuple[np.ndarray, np.ndarray]:
    """Low- and high-pass taps; the high-pass is the alternating mirror of the low-pass."""
    low = np.asarray(LOW_PASS[wavelet])
    high = low[::-1] * np.where(np.arange(len(low)) % 2 == 0, -1.0, 1.0)
    return low, high


def halo_for(wavelet: str, levels: int) -> int:
    """Pixels a tile needs around itself."""
    return len(LOW_PASS[wavelet]) * 2**levels


def subbands(levels: int) -> list[str]:
    return [f"approx_L{levels}"] + [
        f"detail_{d}_L{k}" for k in range(levels, 0, -1) for d in ("H", "V", "D")
    ]


def mirrored(index: np.ndarray, n: int) -> np.ndarray:
    """Half-sample symmetric extension of positions outside [0, n)."""
    index = np.mod(index, 2 * n)
    return np.where(index < n, index, 2 * n - 1 - index)


def _owned(start: int, size: int, extent: int, taps: int, levels: int):
    """Per level the coefficients this tile owns, the range it must compute, and the input length."""
    lengths = [extent]
    for _ in range(levels):
        lengths.append((lengths[-1] + taps - 1) // 2)
    own = []
    for k in range(1, levels + 1):
        step = 2**k
        last = lengths[k] if start + size == extent else -(-(start + size) // step)
        own.append((min(-(-start // step), lengths[k]), last))
    need = [None] * (levels + 1)
    low, high = own[-1]
    for k in range(levels, -1, -1):
        if k and k < levels:
            low, high = min(low, own[k - 1][0]), max(high, own[k - 1][1])
        need[k] = (low, high)
        if k:
            reach = mirrored(np.arange(2 * low + 2 - taps, max(2 * high, 2 * low + 1)), lengths[k - 1])
            low, high = int(reach.min()), int(reach.max()) + 1
    return lengths, own, need


def _analyse(x: np.ndarray, offset: int, need: tuple[int, int], n: int, taps: np.ndarray, axis: int):
    """Filter along one axis and keep every second sample, for the needed coefficients only."""
    base = 2 * np.arange(*need) + 1
    total = 0.0
    for j, weight in enumerate(taps):
        total = total + weight * np.take(x, mirrored(base - j, n) - offset, axis=axis)
    return total


def tile_subbands(row, wavelet: str, levels: int):
    """(subband, coefficients owned by the tile) for all subbands."""
    low, high = filters(wavelet)
    rows = _owned(row.r0, row.nr, row.h, len(low), levels)
    cols = _owned(row.c0, row.nc, row.w, len(low), levels)
    data = pixels(row).astype(np.float64)
    at_r, at_c = row.r0 - row.top, row.c0 - row.left
    for k in range(1, levels + 1):
        bands = {}
        for tag_r, taps_r in (("a", low), ("d", high)):
            half = _analyse(data, at_r, rows[2][k], rows[0][k - 1], taps_r, 0)
            for tag_c, taps_c in (("a", low), ("d", high)):
                bands[tag_r + tag_c] = _analyse(half, at_c, cols[2][k], cols[0][k - 1], taps_c, 1)
        at_r, at_c = rows[2][k][0], cols[2][k][0]
        (r_from, r_to), (c_from, c_to) = rows[1][k - 1], cols[1][k - 1]
        cut = np.s_[r_from - at_r : r_to - at_r, c_from - at_c : c_to - at_c]
        for name, tag in (("H", "da"), ("V", "ad"), ("D", "dd")):
            yield f"detail_{name}_L{k}", bands[tag][cut]
        data = bands["aa"]
        if k == levels:
            yield f"approx_L{levels}", data[cut]


def subband_stats(tiles: DataFrame, wavelet: str = "db4", levels: int = 3) -> DataFrame:
    """Energy, mean, deviation, range and size per subband.

    (image_id, band, n, energy, mean, std, lo, hi, peak). Tiles need ``halo_for`` pixels of halo.
    """

    def kernel(row):
        out = {k: [] for k in ("band", "n", "energy", "total", "m2", "lo", "hi")}
        for name, c in tile_subbands(row, wavelet, levels):
            if c.size:
                out["band"].append(name)
                out["n"].append(c.size)
                out["energy"].append(float((c * c).sum()))
                out["total"].append(float(c.sum()))
                out["m2"].append(float(((c - c.mean()) ** 2).sum()))
                out["lo"].append(float(c.min()))
                out["hi"].append(float(c.max()))
        return out

    n, total = F.col("n"), F.col("total")
    mean = F.sum(total) / F.sum(n)
    between = F.sum(total * total / n) / F.sum(n) - mean * mean
    return (
        map_rows(
            tiles,
            "image_id",
            "band string, n long, energy double, total double, m2 double, lo double, hi double",
            kernel,
        )
        .groupBy("image_id", "band")
        .agg(
            F.sum("energy").alias("energy"),
            mean.alias("mean"),
            F.sqrt(
                F.sum("m2") / F.sum(n)
                + F.when(F.count(n) > 1, F.greatest(between, F.lit(0.0))).otherwise(0.0)
            ).alias("std"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.greatest(F.max("hi"), -F.min("lo")).alias("peak"),
            F.sum(n).alias("n"),
        )
    )


def subband_entropy(
    tiles: DataFrame, stats: DataFrame, wavelet: str = "db4", levels: int = 3, bins: int = ENTROPY_BINS
) -> DataFrame:
    """Density-histogram entropy per subband over its own range: (image_id, band, entropy)."""
    ranges = stage(
        stats.groupBy("image_id").agg(
            F.map_from_entries(F.collect_list(F.struct("band", F.array("lo", "hi")))).alias("ranges")
        )
    )

    def kernel(row):
        ranges = dict(row.ranges)
        out = {"band": [], "bin": [], "c": []}
        for name, c in tile_subbands(row, wavelet, levels):
            if c.size:
                low, high = ranges[name]
                counts = np.histogram(c, bins=bins, range=(low, high))[0]
                used = np.flatnonzero(counts)
                out["band"] += [name] * len(used)
                out["bin"] += used.tolist()
                out["c"] += counts[used].tolist()
        return out

    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0 / bins)
    return (
        map_rows(tiles.join(ranges, "image_id"), "image_id", "band string, bin int, c long", kernel)
        .groupBy("image_id", "band", "bin")
        .agg(F.sum("c").alias("c"))
        .join(stats.select("image_id", "band", "n", "lo", "hi"), ["image_id", "band"])
        .groupBy("image_id", "band")
        .agg(F.sum(entropy_term(F.col("c") / (F.col("n") * width))).alias("entropy"))
    )


def energy_ratios(stats: DataFrame) -> DataFrame:
    """Share of approximation and detail energy, and of each direction within the detail."""

    def part(pattern):
        return F.sum(F.when(F.col("band").like(pattern), F.col("energy")).otherwise(0.0))

    sums = stats.groupBy("image_id").agg(
        part("approx%").alias("a"),
        part("detail%").alias("d"),
        part("detail_H%").alias("eh"),
        part("detail_V%").alias("ev"),
        part("detail_D%").alias("ed"),
    )
    total, detail = F.col("a") + F.col("d"), F.col("d")
    return sums.select(
        "image_id",
        safe_div(F.col("a"), total, 0.0).alias("wavelet_ratio_approx_total"),
        safe_div(detail, total, 0.0).alias("wavelet_ratio_detail_total"),
        safe_div(F.col("eh"), detail, 0.0).alias("wavelet_ratio_horizontal"),
        safe_div(F.col("ev"), detail, 0.0).alias("wavelet_ratio_vertical"),
        safe_div(F.col("ed"), detail, 0.0).alias("wavelet_ratio_diagonal"),
    )


def wavelet_features(tiles: DataFrame, wavelet: str = "db4", levels: int = 3) -> DataFrame:
    """The wavelet_* columns (65 for three levels)."""
    stats = stage(subband_stats(tiles, wavelet, levels))
    table = stats.join(subband_entropy(tiles, stats, wavelet, levels), ["image_id", "band"])
    source = {"energy": "energy", "entropy": "entropy", "mean": "mean", "std": "std", "max": "peak", "n_coeffs": "n"}
    wide = table.groupBy("image_id").agg(
        *[
            F.expr(f"max(if(band = '{band}', CAST({column} AS DOUBLE), NULL)) AS wavelet_{kind}_{band}")
            for band in subbands(levels)
            for kind, column in source.items()
        ]
    )
    return wide.join(energy_ratios(stats), "image_id")
