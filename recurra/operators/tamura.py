"""Tamura texture features: coarseness, contrast, directionality, line-likeness, roughness.

Everything is a sum or a maximum over tiles. Sums are taken on integer pixels, so they do not
depend on how an image was cut.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .blocks import BLOCK, map_rows
from .recurrence import PARTS, assemble_tiles, core, gray_counts, pixels, rectangle, with_halo
from .texture import count_moments

K_MAX = 6
DIRECTION_BINS = 16
MAX_DISTANCE = 5
DIRECTIONS = ((0, 1), (1, 1), (1, 0), (1, -1))
HALO = 2**K_MAX + 2**K_MAX // 2
NAMES = ("coarseness", "contrast", "directionality", "linelikeness", "roughness")


def _padded(row, reach: int, mode: str) -> np.ndarray:
    """Core plus ``reach`` pixels on every side, extended only where the image ends."""
    window, pads = [], []
    for start, size, before, extent in (
        (row.top, row.nr, row.r0, row.h), (row.left, row.nc, row.c0, row.w)
    ):
        after = extent - before - size
        window.append(slice(start - min(reach, before), start + size + min(reach, after)))
        pads.append((max(0, reach - before), max(0, reach - after)))
    return np.pad(pixels(row)[tuple(window)].astype(np.int64), pads, mode=mode)


def scales(side: int, k_max: int = K_MAX) -> int:
    """Number of window sizes for the shorter side of an image."""
    return max(1, min(k_max, int(np.log2(max(side // 4, 1)))))


def best_scales(row, k_max: int = K_MAX) -> np.ndarray:
    """Per core pixel the scale whose neighbouring box means differ most (first on ties).

    Box sums of scale k are compared after bringing all scales to a common denominator.
    """
    side = min(row.h, row.w)
    count = scales(side, k_max)
    reach = 2**count + 2 ** (count - 1)
    px = _padded(row, reach, "symmetric")
    prefix = np.zeros((px.shape[0] + 1, px.shape[1] + 1), dtype=np.int64)
    prefix[1:, 1:] = px.cumsum(axis=0).cumsum(axis=1)
    r = np.arange(row.nr)[:, None] + reach
    c = np.arange(row.nc)[None, :] + reach
    rows, cols = r - reach + row.r0, c - reach + row.c0
    best = np.zeros((row.nr, row.nc), dtype=np.int64)
    top = np.full((row.nr, row.nc), -1, dtype=np.int64)
    for k in range(count):
        half, step = 2**k, 2**k
        if 2 * half > side // 2 or step >= side // 2:
            break

        def box(dr, dc):
            a, b = r + dr - half, r + dr + half
            p, q = c + dc - half, c + dc + half
            return prefix[b, q] - prefix[a, q] - prefix[b, p] + prefix[a, p]

        scale = 4 ** (count - 1 - k)
        down = np.where(
            (rows >= step) & (rows < row.h - step), np.abs(box(step, 0) - box(-step, 0)), 0
        )
        across = np.where(
            (cols >= step) & (cols < row.w - step), np.abs(box(0, step) - box(0, -step)), 0
        )
        change = np.maximum(down, across) * scale
        better = change > top
        best[better] = k
        top[better] = change[better]
    return best


def _gradient(row):
    px = _padded(row, 1, "reflect")
    smooth_r = px[:-2] + 2 * px[1:-1] + px[2:]
    smooth_c = px[:, :-2] + 2 * px[:, 1:-1] + px[:, 2:]
    return smooth_r[:, 2:] - smooth_r[:, :-2], smooth_c[2:] - smooth_c[:-2]


def _shifted(row):
    """(direction, distance, (n, a, b, ab, aa, bb)): sums over a tile's pixels and those next to them."""
    px = pixels(row).astype(np.int64)
    square = px * px
    for number, (dr, dc) in enumerate(DIRECTIONS):
        for d in range(1, MAX_DISTANCE + 1):
            bottom = min(row.top + row.nr, row.ph - d * dr)
            left = max(row.left, -d * dc)
            right = min(row.left + row.nc, row.pw - d * dc)
            if bottom <= row.top or right <= left:
                continue
            here = slice(row.top, bottom), slice(left, right)
            there = slice(row.top + d * dr, bottom + d * dr), slice(left + d * dc, right + d * dc)
            a, b = px[here], px[there]
            yield number, d, (a.size, a.sum(), b.sum(), (a * b).sum(), square[here].sum(), square[there].sum())


def tile_sums(tiles: DataFrame, k_max: int = K_MAX) -> DataFrame:
    """One pass for the additive parts: (image_id, what, k, total, top).

    what: 'coarse' (sum of 2^k), 'grad' (top = largest squared gradient), 'corr' with
    k = direction * 100 + distance * 10 + moment (n, a, b, ab, aa, bb).
    """

    def kernel(row):
        what, keys, values = ["coarse", "grad"], [0, 0], []
        values.append(int((1 << best_scales(row, k_max)).sum()))
        gx, gy = _gradient(row)
        values.append(int((gx * gx + gy * gy).max()))
        for number, d, moments in _shifted(row):
            for m, value in enumerate(moments):
                what.append("corr")
                keys.append(number * 100 + d * 10 + m)
                values.append(int(value))
        return {"what": what, "k": keys, "v": values}

    return (
        map_rows(tiles, "image_id", "what string, k int, v long", kernel)
        .groupBy("image_id", "what", "k")
        .agg(F.sum("v").alias("total"), F.max("v").alias("top"))
    )


def _directions(gx: np.ndarray, gy: np.ndarray, top: int, threshold: float = 0.1, bins: int = DIRECTION_BINS) -> np.ndarray:
    size = np.sqrt((gx * gx + gy * gy).astype(np.float64))
    keep = size > threshold * np.sqrt(float(top))
    angle = np.degrees(np.arctan2(gy[keep], gx[keep])) % 180
    slot = np.minimum((angle / 180.0 * bins).astype(np.int64), bins - 1)
    return np.bincount(slot, weights=size[keep], minlength=bins)


def direction_histogram(
    tiles: DataFrame, peaks: DataFrame, threshold: float = 0.1, bins: int = DIRECTION_BINS
) -> DataFrame:
    """Magnitude-weighted edge directions over [0, 180) degrees: (image_id, bin, weight).

    ``peaks`` is (image_id, top): the largest squared gradient of each image.
    """

    def kernel(row):
        weight = _directions(*_gradient(row), row.top2, threshold, bins)
        used = np.flatnonzero(weight)
        return {"bin": used, "weight": weight[used]}

    return (
        map_rows(
            tiles.join(peaks.select("image_id", F.col("top").alias("top2")), "image_id"),
            "image_id",
            "bin int, weight double",
            kernel,
        )
        .groupBy("image_id", "bin")
        .agg(F.sum("weight").alias("weight"))
    )


def directionality(hist: DataFrame, bins: int = DIRECTION_BINS) -> DataFrame:
    """1 - H / log2(bins) of the direction histogram."""
    w = F.col("weight")
    # entropy of w / W = log2 W - (1/W) sum w log2 w
    return hist.groupBy("image_id").agg(
        (
            1
            - (F.log2(F.sum(w)) - F.sum(F.when(w > 0, w * F.log2(w)).otherwise(0.0)) / F.sum(w))
            / F.lit(float(np.log2(bins)))
        ).alias("directionality")
    )


def line_likeness(sums: DataFrame) -> DataFrame:
    """Spread over the four directions of the mean correlation at distances 1..5."""
    picks = [
        F.sum(F.when(F.col("k") % 10 == m, F.col("total"))).cast("double").alias(name)
        for m, name in enumerate(("n", "a", "b", "ab", "aa", "bb"))
    ]
    n = F.col("n")
    var_a = F.col("aa") / n - (F.col("a") / n) ** 2
    var_b = F.col("bb") / n - (F.col("b") / n) ** 2
    cov = F.col("ab") / n - F.col("a") / n * F.col("b") / n
    corr = F.when((var_a > 0) & (var_b > 0), cov / F.sqrt(var_a * var_b))
    return (
        sums.filter("what = 'corr'")
        .groupBy("image_id", F.floor(F.col("k") / 10).alias("pair"))
        .agg(*picks)
        .groupBy("image_id", F.floor(F.col("pair") / 10).alias("dir"))
        .agg(F.coalesce(F.avg(corr), F.lit(0.0)).alias("corr"))
        .groupBy("image_id")
        .agg((F.max("corr") - F.min("corr")).alias("linelikeness"))
    )


def contrast(counts: DataFrame) -> DataFrame:
    """sigma / kurtosis^(1/4) on the [0, 1] scale; the kurtosis is not excess."""
    m = count_moments(counts)
    alpha = F.when(F.col("kurtosis") + 3 > 0, F.col("kurtosis") + 3).otherwise(F.lit(0.0001))
    return m.select("image_id", (F.col("std") / 255.0 / F.pow(alpha, F.lit(0.25))).alias("contrast"))


def measures(tiles: DataFrame, k_max: int = K_MAX) -> DataFrame:
    """The five measures of every image from tiles with ``HALO`` pixels of halo."""
    sums = stage(tile_sums(tiles, k_max))
    peaks = sums.filter("what = 'grad'").select("image_id", "top")
    area = tiles.groupBy("image_id").agg((F.first("h") * F.first("w")).alias("area"))
    coarse = (
        sums.filter("what = 'coarse'")
        .join(area, "image_id")
        .select("image_id", (F.col("total") / F.col("area")).alias("coarseness"))
    )
    out = coarse.join(contrast(gray_counts(tiles)), "image_id")
    direction = directionality(direction_histogram(tiles, peaks))
    return (
        out.join(direction, "image_id", "left")
        .join(line_likeness(sums), "image_id", "left")
        .select(
            "image_id",
            "coarseness",
            "contrast",
            F.coalesce("directionality", F.lit(0.0)).alias("directionality"),
            F.coalesce("linelikeness", F.lit(0.0)).alias("linelikeness"),
            (F.col("coarseness") + F.col("contrast")).alias("roughness"),
        )
    )


def whole_measures(row, k_max: int = K_MAX) -> dict[str, float]:
    """The five measures of an image that is one tile, by the same formulas as ``measures``."""
    coarse = int((1 << best_scales(row, k_max)).sum()) / (row.h * row.w)
    gx, gy = _gradient(row)
    weight = _directions(gx, gy, int((gx * gx + gy * gy).max()))
    used = weight[weight > 0]
    lines: dict[int, list[float]] = {}
    for number, _, (n, a, b, ab, aa, bb) in _shifted(row):
        a, b = a / n, b / n
        var_a, var_b = aa / n - a**2, bb / n - b**2
        found = lines.setdefault(number, [])
        if var_a > 0 and var_b > 0:
            found.append((ab / n - a * b) / np.sqrt(var_a * var_b))
    means = [sum(found) / len(found) if found else 0.0 for found in lines.values()]
    c = np.bincount(core(row).ravel(), minlength=256)
    v, n = np.arange(256.0), row.h * row.w
    dev = v - (v * c).sum() / n
    m2, m4 = (c * dev**2).sum() / n, (c * dev**4).sum() / n
    alpha = m4 / (m2 * m2) if m2 * m2 > 0 else 0.0
    shade = np.sqrt(m2) / 255.0 / (alpha if alpha > 0 else 0.0001) ** 0.25
    direction = 1 - (np.log2(used.sum()) - (used * np.log2(used)).sum() / used.sum()) / np.log2(DIRECTION_BINS) if len(used) else 0.0
    return dict(zip(NAMES, (coarse, shade, direction, max(means) - min(means) if means else 0.0, coarse + shade)))


LARGE = 100_000_000  # pixels above which an image is measured in regions
REGION, OVERLAP, SMALLEST = 8192, 512, 64


def _spans(extent: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, length) of the regions along one side of a large image."""
    step = size - overlap
    count = -(-(extent - size) // step) + 1 if extent > size else 1
    return [(k * step, min(size, extent - k * step)) for k in range(count)]


def regions(
    tiles: DataFrame,
    size: int = REGION,
    overlap: int = OVERLAP,
    smallest: int = SMALLEST,
    threshold: int = LARGE,
    tile: int = BLOCK,
) -> DataFrame:
    """Cut images above ``threshold`` pixels into overlapping regions, each an image of its own.

    Tiles may have any size and grid: they are cut at the borders of the regions and put together again as tiles
    of side ``tile``, counted from the region's corner. ``image_id`` becomes (image, row, column of the region).
    """

    def spans(extent, large):
        return _spans(extent, size, overlap) if large else [(0, extent)]

    def cut(row):
        img, out = core(row), []
        large = row.h * row.w > threshold
        for y, (top, height) in enumerate(spans(row.h, large)):
            for x, (left, width) in enumerate(spans(row.w, large)):
                if top >= row.r0 + row.nr or left >= row.c0 + row.nc or top + height <= row.r0 or left + width <= row.c0:
                    continue
                if large and min(height, width) < smallest:
                    continue
                for r in range(max(0, row.r0 - top) // tile * tile, height, tile):
                    if top + r >= row.r0 + row.nr:
                        break
                    for c in range(max(0, row.c0 - left) // tile * tile, width, tile):
                        if left + c >= row.c0 + row.nc:
                            break
                        nr, nc = min(tile, height - r), min(tile, width - c)
                        part = rectangle(img, row.r0 - top, row.c0 - left, (r, c), (r + nr, c + nc))
                        if part:
                            place = {"y": y, "x": x, "h": height, "w": width, "r0": r, "c0": c, "nr": nr, "nc": nc, "halo": 0}
                            out.append(place | part)
        return {name: [part[name] for part in out] for name in out[0]} if out else None

    parts = map_rows(tiles, "image_id", "y int, x int, " + PARTS, cut)
    named = F.struct(F.col("image_id").alias("image"), "y", "x").alias("image_id")
    return assemble_tiles(parts.select(named, *[c for c in parts.columns if c not in ("image_id", "y", "x")]))


def region_measures(tiles: DataFrame, k_max: int, size: int, overlap: int, smallest: int) -> DataFrame:
    """``measures`` of the regions of large images that are one tile each, cut and measured where the tile is."""

    def kernel(row):
        img, out = core(row), {name: [] for name in ("y", "x", *NAMES)}
        for y, (top, height) in enumerate(_spans(row.h, size, overlap)):
            for x, (left, width) in enumerate(_spans(row.w, size, overlap)):
                if min(height, width) < smallest:
                    continue
                px = np.ascontiguousarray(img[top : top + height, left : left + width]).tobytes()
                part = SimpleNamespace(h=height, w=width, r0=0, c0=0, nr=height, nc=width, top=0, left=0, ph=height, pw=width, px=px)
                for name, value in {"y": y, "x": x, **whole_measures(part, k_max)}.items():
                    out[name].append(value)
        return out if out["y"] else None

    found = map_rows(tiles, "image_id", "y int, x int, " + ", ".join(f"{n} double" for n in NAMES), kernel)
    return found.select(F.struct(F.col("image_id").alias("image"), "y", "x").alias("image_id"), *NAMES)


def tamura_features(
    tiles: DataFrame,
    k_max: int = K_MAX,
    threshold: int = LARGE,
    size: int = REGION,
    overlap: int = OVERLAP,
    smallest: int = SMALLEST,
) -> DataFrame:
    """tamura_*_mean and _std columns: of whole images, of those above ``threshold`` pixels over their regions."""
    area = F.col("h") * F.col("w")
    whole = measures(tiles.filter(area <= threshold), k_max).select(
        "image_id",
        *[
            c
            for n in NAMES
            for c in (F.col(n).alias(f"tamura_{n}_mean"), F.lit(0.0).alias(f"tamura_{n}_std"))
        ],
    )
    alone = (F.col("nr") == F.col("h")) & (F.col("nc") == F.col("w"))
    found = whole.unionByName(
        regional_features(region_measures(tiles.filter((area > threshold) & alone), k_max, size, overlap, smallest))
    )
    large = tiles.filter((area > threshold) & ~alone)
    if large.isEmpty():
        return found
    cut = with_halo(regions(large, size, overlap, smallest, threshold), HALO)
    return found.unionByName(regional_features(measures(stage(cut), k_max)))


def regional_features(found: DataFrame) -> DataFrame:
    """Mean and population deviation over the regions of ``measures(regions(...))``."""
    finite = F.lit(True)
    for n in NAMES:
        finite = finite & F.col(n).isNotNull() & ~F.isnan(n)
    return (
        found.filter(finite)
        .groupBy(F.col("image_id.image").alias("image_id"))
        .agg(
            *[
                c
                for n in NAMES
                for c in (
                    F.avg(n).alias(f"tamura_{n}_mean"),
                    F.stddev_pop(n).alias(f"tamura_{n}_std"),
                )
            ]
        )
    )


