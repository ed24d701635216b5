"""Gabor filter bank on image tiles: response statistics per frequency and orientation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import safe_div
from ..session import stage
from .blocks import map_rows
from .chunks import QUANTILE_BINS, quantiles_inside, wanted_bins
from .recurrence import pixels

FREQUENCIES = (0.1, 0.2, 0.4)
ORIENTATIONS = (0, 45, 90, 135)
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def halo_for(sigma: float = 1.0) -> int:
    return math.ceil(3 * sigma)


def axis_taps(frequency: float, degrees: float, sigma: float):
    """The isotropic complex kernel is a product: taps along rows and along columns."""
    theta = math.radians(degrees)
    spread = 3 * sigma
    reach = math.ceil(max(abs(spread * math.cos(theta)), abs(spread * math.sin(theta)), 1))
    t = np.arange(-reach, reach + 1)
    bell = np.exp(-0.5 * (t / sigma) ** 2)
    down = bell * np.exp(2j * np.pi * frequency * t * math.sin(theta))
    across = bell * np.exp(2j * np.pi * frequency * t * math.cos(theta)) / (2 * np.pi * sigma**2)
    return down, across


def _response(row, frequency, degrees, sigma):
    """Complex response on the tile's core; half-sample reflection at the image border only."""
    down, across = axis_taps(frequency, degrees, sigma)
    reach = len(down) // 2
    data = pixels(row).astype(np.float64) / 255.0
    window, pads = [], []
    for start, size, before, extent in (
        (row.top, row.nr, row.r0, row.h), (row.left, row.nc, row.c0, row.w)
    ):
        after = extent - before - size
        window.append(slice(start - min(reach, before), start + size + min(reach, after)))
        pads.append((max(0, reach - before), max(0, reach - after)))
    data = np.pad(data[tuple(window)], pads, mode="symmetric")
    # Convolution: the kernel's first tap meets the last sample of the window.
    rows = sum(w * data[2 * reach - j : 2 * reach - j + row.nr] for j, w in enumerate(down))
    return sum(w * rows[:, 2 * reach - j : 2 * reach - j + row.nc] for j, w in enumerate(across))


def _bank(frequencies, orientations):
    return [(f"f{f}_o{int(o)}", f, o) for f in frequencies for o in orientations]


def _quantiles(values: np.ndarray, shares) -> list[float]:
    """Quantiles by linear interpolation between the two nearest ranks."""
    order, out = np.sort(values, axis=None), []
    for share in shares:
        h = (order.size - 1) * share
        low, high = order[math.floor(h)], order[math.ceil(h)]
        out.append(float(low + (high - low) * (h - math.floor(h))))
    return out


def response_stats(
    tiles: DataFrame, frequencies=FREQUENCIES, orientations=ORIENTATIONS, sigma: float = 1.0
) -> DataFrame:
    """Statistics per filter: (image_id, filter, n, mag_*, energy_*, phase_*...).

    The magnitudes' quartiles are known here for images that lie in one tile, and NULL for others.
    """
    bank = _bank(frequencies, orientations)
    names = ("mag", "mag2", "re", "im", "re2", "im2", "phase", "phase2", "cos", "sin")

    def kernel(row):
        out = {k: [] for k in ("filter", "n", "lo", "hi", *names, *QUARTILES)}
        whole = row.nr == row.h and row.nc == row.w
        for name, f, o in bank:
            z = _response(row, f, o, sigma)
            mag, phase = np.abs(z), np.angle(z)
            values = (
                mag, mag * mag, z.real, z.imag, z.real**2, z.imag**2,
                phase, phase**2, np.cos(phase), np.sin(phase),
            )
            out["filter"].append(name)
            out["n"].append(z.size)
            out["lo"].append(float(mag.min()))
            out["hi"].append(float(mag.max()))
            for key, value in zip(names, values):
                out[key].append(float(value.sum()))
            for key, value in zip(QUARTILES, _quantiles(mag, QUARTILES.values()) if whole else [None] * len(QUARTILES)):
                out[key].append(value)
        return out

    schema = "filter string, n long, lo double, hi double, " + ", ".join(f"{k} double" for k in (*names, *QUARTILES))
    n = F.sum("n")

    def mean(col):
        return F.sum(col) / n

    def std(col, square):
        return F.sqrt(F.greatest(mean(square) - mean(col) * mean(col), F.lit(0.0)))

    total = F.sum("re2") + F.sum("im2")
    return (
        map_rows(tiles, "image_id", schema, kernel)
        .groupBy("image_id", "filter")
        .agg(
            n.alias("n"),
            mean("mag").alias("mag_mean"),
            std("mag", "mag2").alias("mag_std"),
            F.max("hi").alias("mag_max"),
            F.min("lo").alias("mag_min"),
            F.sum("re2").alias("energy_real"),
            F.sum("im2").alias("energy_imag"),
            total.alias("energy_total"),
            safe_div(F.sum("re2"), total, 0.5).alias("energy_ratio"),
            mean("re").alias("real_mean"),
            mean("im").alias("imag_mean"),
            std("re", "re2").alias("real_std"),
            std("im", "im2").alias("imag_std"),
            mean("phase").alias("phase_mean"),
            std("phase", "phase2").alias("phase_std"),
            F.sqrt(mean("cos") * mean("cos") + mean("sin") * mean("sin")).alias("phase_coherence"),
            *[F.max(q).alias(q) for q in QUARTILES],
        )
    )


def magnitude_quartiles(
    tiles: DataFrame,
    stats: DataFrame,
    frequencies=FREQUENCIES,
    orientations=ORIENTATIONS,
    sigma: float = 1.0,
) -> DataFrame:
    """Exact quartiles of the magnitudes per filter: (image_id, filter, n, q25, median, q75).

    Those of images in one tile come with ``stats``; for others a histogram and a refinement of two bins each.
    """
    bank = _bank(frequencies, orientations)
    keys = ["image_id", "filter"]
    known = stats.filter(F.col("median").isNotNull()).select(*keys, "n", *QUARTILES)
    stats = stats.filter(F.col("median").isNull())
    if stats.isEmpty():
        return known
    spans = stage(
        stats.groupBy("image_id").agg(
            F.map_from_entries(
                F.collect_list(F.struct("filter", F.array("mag_min", "mag_max")))
            ).alias("spans")
        )
    )

    def bins_of(mag, low, high):
        if high <= low:
            return np.zeros(mag.shape, dtype=np.int64)
        scaled = (mag - low) / (high - low) * QUANTILE_BINS
        return np.minimum(scaled.astype(np.int64), QUANTILE_BINS - 1)

    def histogram(row):
        spans = dict(row.spans)
        out = {"filter": [], "_bin": [], "_c": []}
        for name, f, o in bank:
            counts = np.bincount(bins_of(np.abs(_response(row, f, o, sigma)), *spans[name]).ravel())
            used = np.flatnonzero(counts)
            out["filter"] += [name] * len(used)
            out["_bin"] += used.tolist()
            out["_c"] += counts[used].tolist()
        return out

    counts = (
        map_rows(tiles.join(spans, "image_id"), "image_id", "filter string, _bin long, _c long", histogram)
        .groupBy(*keys, "_bin")
        .agg(F.sum("_c").alias("_c"))
        .join(stats.select(*keys, "n"), keys)
    )
    wanted = stage(wanted_bins(counts, keys, QUARTILES))
    lists = stage(
        wanted.groupBy(*keys).agg(F.collect_list("_bin").alias("bins"))
        .groupBy("image_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("filter", "bins"))).alias("bins"))
        .join(spans, "image_id")
    )

    def members(row):
        spans, bins = dict(row.spans), dict(row.bins)
        out = {"filter": [], "_bin": [], "_v": [], "_c": []}
        for name, f, o in bank:
            mag = np.abs(_response(row, f, o, sigma)).ravel()
            where = bins_of(mag, *spans[name])
            values, counts = np.unique(mag[np.isin(where, bins[name])], return_counts=True)
            out["filter"] += [name] * len(values)
            out["_bin"] += bins_of(values, *spans[name]).tolist()
            out["_v"] += values.tolist()
            out["_c"] += counts.tolist()
        return out

    inside = (
        map_rows(
            tiles.join(lists, "image_id"),
            "image_id",
            "filter string, _bin long, _v double, _c long",
            members,
        )
        .groupBy(*keys, "_bin", "_v")
        .agg(F.sum("_c").alias("_c"))
        .join(wanted, [*keys, "_bin"])
    )
    return known.unionByName(quantiles_inside(inside, keys, QUARTILES))


GABOR_KINDS = (
    "mag_mean", "mag_std", "mag_max", "mag_min", "mag_q25", "mag_median", "mag_q75",
    "energy_real", "energy_imag", "energy_total", "energy_ratio",
    "real_mean", "imag_mean", "real_std", "imag_std",
)
PHASE_KINDS = ("phase_mean", "phase_std", "phase_coherence")


def check_bank(frequencies, orientations, sigma: float) -> None:
    """Raise for a bank that has no filter or a filter without a meaning; orientations are in degrees."""
    if not frequencies or not orientations:
        raise ValueError("a bank needs at least one frequency and one orientation")
    if min(frequencies) <= 0 or sigma <= 0:
        raise ValueError("frequencies and sigma are positive")
    if any(not 0 <= o <= 360 for o in orientations):
        raise ValueError("orientations are degrees from 0 to 360")


def gabor_features(
    tiles: DataFrame,
    frequencies=FREQUENCIES,
    orientations=ORIENTATIONS,
    sigma: float = 1.0,
    phase: bool = False,
) -> DataFrame:
    """The gabor_* columns: 15 per filter (18 with phase)."""
    check_bank(frequencies, orientations, sigma)
    stats = stage(response_stats(tiles, frequencies, orientations, sigma))
    quartiles = magnitude_quartiles(tiles, stats, frequencies, orientations, sigma).select(
        "image_id", "filter", *[F.col(q).alias(f"mag_{q}") for q in QUARTILES]
    )
    table = stats.drop(*QUARTILES).join(quartiles, ["image_id", "filter"])
    kinds = GABOR_KINDS + (PHASE_KINDS if phase else ())
    return table.groupBy("image_id").agg(
        *[
            F.expr(f"max(if(filter = '{name}', {kind}, NULL)) AS `gabor_{kind}_{name}`")
            for name, _, _ in _bank(frequencies, orientations)
            for kind in kinds
        ]
    )
