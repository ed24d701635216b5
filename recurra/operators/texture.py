"""Image texture: co-occurrence, local binary patterns and first-order statistics.

All three are sums over tiles: each tile contributes counts, Spark adds them up, and the features
are column expressions over at most 65 536 (co-occurrence) or 256 rows per image.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import entropy_term, lerp, safe_div
from .blocks import map_rows
from .recurrence import gray_counts, pixels

# Co-occurrence angles in degrees.
ANGLES = (0, 45, 90, 135)

GLCM_PROPS = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "ASM")


def glcm_step(angle: int, distance: int) -> tuple[int, int]:
    """(row, column) step of a pixel pair, each rounded to whole pixels."""
    turn = math.radians(angle)
    return round(distance * math.sin(turn)), round(distance * math.cos(turn))


CELLS_HELD = 256  # dense count arrays that a task keeps before it emits them
DONE_HELD = 16384  # rows of finished images, likewise


def _tile_counts(row, levels: int, combos):
    """((distance, angle), dense counts of ordered level pairs) of a tile."""
    px = pixels(row).astype(np.int64)
    if levels < 256:
        px = px * (levels - 1) // 255
    r1, c1 = row.top + row.nr, row.left + row.nc
    for distance, angle, dr, dc in combos:
        top, bottom = row.top, min(r1, row.ph - dr)
        left, right = max(row.left, -dc), min(c1, row.pw - dc)
        if bottom <= top or right <= left:
            continue
        here = px[top:bottom, left:right]
        there = px[top + dr : bottom + dr, left + dc : right + dc]
        yield (distance, angle), np.bincount((here * levels + there).ravel(), minlength=levels * levels)


def _map_counts(tiles: DataFrame, schema: str, levels: int, distances, angles, show, finish=None) -> DataFrame:
    """Rows that ``show`` makes of the counts a task has added up per image, distance and angle.

    An image that lies in one tile needs no other task: with ``finish`` it gives what that makes of its counts instead.
    """
    if not distances or not angles or min(distances) < 1:
        raise ValueError("co-occurrence needs at least one angle and distances of 1 or more")
    key = tiles.schema["image_id"].dataType.simpleString()
    combos = [(d, a, *glcm_step(a, d)) for d in distances for a in angles]
    schema = f"image_id {key}, distance int, angle int, {schema}"
    names = T._parse_datatype_string(schema).names

    def frame(image, distance, angle, columns):
        return pd.DataFrame({"image_id": image, "distance": distance, "angle": angle, **columns}).reindex(columns=names)

    def run(batches):
        held: dict = {}
        done: list = []

        def emit():
            for (image, *combo), counts in held.items():
                yield frame(image, *combo, show(counts))

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                alone = finish is not None and row.nr == row.h and row.nc == row.w
                for combo, counts in _tile_counts(row, levels, combos):
                    if alone:
                        done.append({"image_id": row.image_id, "distance": combo[0], "angle": combo[1], **finish(counts)})
                        continue
                    known = held.get((row.image_id, *combo))
                    held[row.image_id, *combo] = counts if known is None else known + counts
                if len(held) > CELLS_HELD:
                    yield from emit()
                    held.clear()
                if len(done) > DONE_HELD:
                    yield pd.DataFrame(done, columns=names)
                    done.clear()
        yield from emit()
        if done:
            yield pd.DataFrame(done, columns=names)

    return tiles.mapInPandas(run, schema)


def glcm_cells(tiles: DataFrame, levels: int = 256, distances=(1,), angles=ANGLES) -> DataFrame:
    """Directed co-occurrence counts: (image_id, distance, angle, a, b, c). Tiles need the largest distance of halo.

    A task adds up the tiles of an image in one dense array per distance and angle and emits the used cells once.
    """

    def show(counts):
        used = np.flatnonzero(counts)
        return {"a": used // levels, "b": used % levels, "c": counts[used]}

    cells = _map_counts(tiles, "a int, b int, c long", levels, distances, angles, show)
    return cells.groupBy("image_id", "distance", "angle", "a", "b").agg(F.sum("c").alias("c"))


def glcm_counts(tiles: DataFrame, levels: int = 256, distance: int = 1, angles=ANGLES) -> DataFrame:
    """Directed co-occurrence counts at one distance: (image_id, angle, a, b, c)."""
    return glcm_cells(tiles, levels, (distance,), angles).drop("distance")


def glcm_moments(tiles: DataFrame, levels: int = 256, distances=(1,), angles=ANGLES) -> DataFrame:
    """Counts per first level with their moments of the second: (image_id, distance, angle, a, c, cb, cbb).

    They add up over tiles, so no cell is shuffled.
    """
    level = np.arange(levels, dtype=np.int64)

    def show(counts):
        table = counts.reshape(levels, levels)
        used = np.flatnonzero(table.sum(axis=1))
        rows = table[used]
        return {"a": used, "c": rows.sum(axis=1), "cb": rows @ level, "cbb": rows @ (level * level)}

    parts = _map_counts(tiles, "a int, c long, cb long, cbb long", levels, distances, angles, show)
    return parts.groupBy("image_id", "distance", "angle", "a").agg(*[F.sum(k).alias(k) for k in ("c", "cb", "cbb")])


def _pair_terms() -> dict:
    """What an unordered level pair adds to the sums behind the properties."""
    a, b, c = F.col("a").cast("double"), F.col("b").cast("double"), F.col("c").cast("double")
    diff = a - b
    return {
        "n": c,
        "s_con": c * diff * diff,
        "s_dis": c * F.abs(diff),
        "s_hom": c / (1 + diff * diff),
        "s_sq": F.when(diff == 0, c * c).otherwise(c * c / 2),
        "s_1": c * (a + b),
        "s_2": c * (a * a + b * b),
        "s_ab": c * a * b,
    }


SUMS = ("n", "s_con", "s_dis", "s_hom", "s_sq", "s_1", "s_2", "s_ab")


def _image_sums(counts: np.ndarray, levels: int) -> dict:
    """The same sums from all ordered counts of an image."""
    used = np.flatnonzero(counts)
    a, b, c = used // levels, used % levels, counts[used]
    square = (a - b) ** 2
    found = (
        c.sum(), c @ square, c @ np.abs(a - b), (c / (1 + square)).sum(), (c @ c + c @ counts[b * levels + a]) / 2,
        c @ (a + b), c @ (a * a + b * b), c @ (a * b),
    )
    return dict(zip(SUMS, map(float, found)))


def _unordered(cells: DataFrame, keys: tuple[str, ...], *more) -> DataFrame:
    return cells.groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("c").alias("c"), *more)


def _properties(sums: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    n = F.col("n")
    mean = F.col("s_1") / (2 * n)
    var = F.col("s_2") / (2 * n) - mean * mean
    asm = F.col("s_sq") / (n * n)
    return sums.select(
        *keys,
        (F.col("s_con") / n).alias("contrast"),
        (F.col("s_dis") / n).alias("dissimilarity"),
        (F.col("s_hom") / n).alias("homogeneity"),
        F.sqrt(asm).alias("energy"),
        F.when(var > 1e-15, (F.col("s_ab") / n - mean * mean) / var)
        .otherwise(F.lit(1.0))
        .alias("correlation"),
        asm.alias("ASM"),
    )


def glcm_angle_props(counts: DataFrame, keys: tuple[str, ...] = ("image_id", "angle")) -> DataFrame:
    """The six properties of the symmetric, normalised matrix of each of the keys.

    Symmetry is folded into the sums: the mean and deviation of rows and columns coincide, and the
    squared mass needs the transposed cell only once, met by grouping on the unordered pair.
    """
    sums = _unordered(counts, keys).groupBy(*keys).agg(*[F.sum(term).alias(name) for name, term in _pair_terms().items()])
    return _properties(sums, keys)


def glcm_props(tiles: DataFrame, levels: int = 256, distances=(1,), angles=ANGLES) -> DataFrame:
    """The six properties of every (image_id, distance, angle).

    An image in one tile gives one row of sums per matrix; cells are shuffled for images of several tiles only.
    """
    keys = ("image_id", "distance", "angle")

    def show(counts):
        used = np.flatnonzero(counts)
        return {"a": used // levels, "b": used % levels, "c": counts[used]}

    schema = "a int, b int, c long, " + ", ".join(f"{name} double" for name in SUMS)
    parts = _map_counts(tiles, schema, levels, distances, angles, show, lambda counts: _image_sums(counts, levels))
    pair = _unordered(parts, keys, *[F.max(name).alias(name) for name in SUMS])
    sums = pair.groupBy(*keys).agg(*[F.sum(F.coalesce(name, term)).alias(name) for name, term in _pair_terms().items()])
    return _properties(sums, keys)


def glcm_features(tiles: DataFrame, levels: int = 256, distances=(1,), angles=ANGLES) -> DataFrame:
    """glcm_* columns: the properties averaged over all distances and angles."""
    props = glcm_props(tiles, levels, distances, angles)
    return props.groupBy("image_id").agg(*[F.avg(p).alias(f"glcm_{p}") for p in GLCM_PROPS])


def _ring(radius: int, points: int):
    angles = 2 * np.pi * np.arange(points) / points
    return np.round(-radius * np.sin(angles), 5), np.round(radius * np.cos(angles), 5)


def lbp_code_array(px: np.ndarray, radius: int, points: int, method: str) -> np.ndarray:
    """Codes of the pixels that have ``radius`` pixels on every side inside ``px``."""
    rows, cols = px.shape[0] - 2 * radius, px.shape[1] - 2 * radius
    centre = px[radius : radius + rows, radius : radius + cols]
    samples = []
    for dy, dx in zip(*_ring(radius, points)):
        y0, x0 = math.floor(dy), math.floor(dx)
        fy, fx = dy - y0, dx - x0
        value = np.zeros((rows, cols))
        for oy, wy in ((0, 1 - fy), (1, fy)):
            for ox, wx in ((0, 1 - fx), (1, fx)):
                if wy * wx:
                    y, x = radius + y0 + oy, radius + x0 + ox
                    value += wy * wx * px[y : y + rows, x : x + cols]
        samples.append(value)
    ring = np.stack(samples)
    if method == "var":
        return np.floor(ring.var(axis=0))  # unit bins: at most 16 257 of them, however many values there are
    bits = (ring >= centre).astype(np.int64)
    ones = bits.sum(axis=0)
    if method == "uniform":
        turns = (bits[1:] != bits[:-1]).sum(axis=0)
        return np.where(turns <= 2, ones, points + 1)
    if method == "nri_uniform":
        # A uniform pattern is told by its number of ones and by its turn; all others share the last code.
        turns = (bits[1:] != bits[:-1]).sum(axis=0)
        turn = np.where(bits[0] == 1, ones - bits.argmin(axis=0), points - bits.argmax(axis=0))
        inner = 1 + (ones - 1) * points + turn
        whole = np.where(ones == 0, 0, points * (points - 1) + 1)
        known = np.where((ones == 0) | (ones == points), whole, inner)
        return np.where(turns <= 2, known, points * (points - 1) + 2)
    weights = 1 << np.arange(points)
    plain = np.tensordot(weights, bits, axes=1)
    if method == "ror":
        best = plain.copy()
        for k in range(1, points):
            best = np.minimum(best, (plain >> k) | ((plain << (points - k)) & ((1 << points) - 1)))
        return best
    if method == "default":
        return plain
    raise ValueError(f"unknown pattern method {method}")


def lbp_codes(
    tiles: DataFrame, radius: int = 1, points: int = 4, method: str = "uniform"
) -> DataFrame:
    """Code counts: (image_id, h, w, code, c). Pixels outside the image count as zero."""

    def kernel(row):
        px = pixels(row).astype(np.float64)
        pads, window = [], []
        for start, size, before, extent in (
            (row.top, row.nr, row.r0, row.h), (row.left, row.nc, row.c0, row.w)
        ):
            after = extent - before - size
            window.append(slice(start - min(radius, before), start + size + min(radius, after)))
            pads.append((max(0, radius - before), max(0, radius - after)))
        codes = lbp_code_array(np.pad(px[tuple(window)], pads), radius, points, method)
        values, counts = np.unique(codes, return_counts=True)
        return {
            "h": np.full(len(values), row.h),
            "w": np.full(len(values), row.w),
            "code": values.astype(np.float64),
            "c": counts,
        }

    return (
        map_rows(tiles, "image_id", "h long, w long, code double, c long", kernel)
        .groupBy("image_id", "code")
        .agg(F.first("h").alias("h"), F.first("w").alias("w"), F.sum("c").alias("c"))
    )


def lbp_features(tiles: DataFrame, radius: int = 1, points: int = 4) -> DataFrame:
    """lbp_* columns of the uniform method (points + 2 histogram bins)."""
    tag = f"_r{radius}_p{points}"
    last = points + 1
    codes = lbp_codes(tiles, radius, points)
    area = (F.first("h") * F.first("w")).cast("double")
    value, c = F.col("code"), F.col("c").cast("double")
    sums = codes.groupBy("image_id").agg(
        *[
            (F.sum(F.when(value == k, c).otherwise(0.0)) / area).alias(f"lbp_hist_bin_{k}{tag}")
            for k in range(points + 2)
        ],
        (F.sum(value * c) / area).alias("_mean"),
        (F.sum(value * value * c) / area).alias("_sq"),
        F.max(value).alias(f"lbp_max{tag}"),
        F.min(value).alias(f"lbp_min{tag}"),
        F.sum((c / (F.col("h") * F.col("w"))) ** 2).alias(f"lbp_uniformity{tag}"),
        F.sum(entropy_term(c / (F.col("h") * F.col("w")))).alias(f"lbp_entropy{tag}"),
        (F.sum(F.when(value < last - 1, c).otherwise(0.0)) / area).alias(f"lbp_uniform_ratio{tag}"),
        (F.sum(F.when(value == last - 1, c).otherwise(0.0)) / area).alias(
            f"lbp_nonuniform_ratio{tag}"
        ),
    )
    var = F.col("_sq") - F.col("_mean") * F.col("_mean")
    order = [f"lbp_hist_bin_{k}{tag}" for k in range(points + 2)]
    order += [
        f"lbp_{s}{tag}"
        for s in ("mean", "std", "max", "min", "uniformity", "entropy", "uniform_ratio", "nonuniform_ratio")
    ]
    return (
        sums.withColumn(f"lbp_mean{tag}", F.col("_mean"))
        .withColumn(f"lbp_std{tag}", F.sqrt(F.greatest(var, F.lit(0.0))))
        .select("image_id", *order)
    )


def lbp_product(tiles: DataFrame, radii=(1, 2, 3), points=(8, 16, 24)) -> DataFrame:
    """lbp_* columns of every radius with every number of points. Tiles need the largest radius of halo."""
    if not radii or not points or min(*radii, *points) < 1:
        raise ValueError("patterns need radii and numbers of points of 1 or more")
    found = None
    for radius in radii:
        for n in points:
            own = lbp_features(tiles, radius, n)
            found = own if found is None else found.join(own, "image_id")
    return found


def lbp_histogram_of(codes: DataFrame, method: str, points: int) -> DataFrame:
    """Shares of all codes of an image's method: (image_id, code, share); codes without a pixel have none.

    'var' has unit bins of the variance, so its rows are bounded by the gray range, not by the number of pixels.
    """
    if method not in ("uniform", "nri_uniform", "ror", "default", "var"):
        raise ValueError(f"unknown pattern method {method}")
    area = F.col("h").cast("double") * F.col("w")
    return codes.select("image_id", F.col("code").cast("int").alias("code"), (F.col("c") / area).alias("share"))


STAT_PERCENTILES = (10, 25, 50, 75, 90)


def count_moments(counts: DataFrame, value: str = "v", extra: list | tuple = ()) -> DataFrame:
    """Moments, range and percentiles from value counts (few distinct values per image).

    ``extra`` aggregates over the same rows ride along.
    """
    whole = Window.partitionBy("image_id")
    running = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    v, c = F.col(value).cast("double"), F.col("c").cast("double")
    table = (
        counts.withColumn("n", F.sum("c").over(whole))
        .withColumn("mu", F.sum(v * c).over(whole) / F.sum("c").over(whole))
        .withColumn("cum", F.sum("c").over(running))
    )
    dev = v - F.col("mu")
    picks = []
    for p in STAT_PERCENTILES:
        h = (F.col("n") - 1) * F.lit(p / 100.0)
        for tag, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            picks.append(F.min(F.when(F.col("cum") > rank, v)).alias(f"_p{p}_{tag}"))
    sums = table.groupBy("image_id").agg(
        F.first("n").alias("n"),
        F.first("mu").alias("mean"),
        (F.sum(c * dev**2) / F.first("n")).alias("m2"),
        (F.sum(c * dev**3) / F.first("n")).alias("m3"),
        (F.sum(c * dev**4) / F.first("n")).alias("m4"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        *picks,
        *extra,
    )
    for p in STAT_PERCENTILES:
        h = (F.col("n") - 1) * F.lit(p / 100.0)
        sums = sums.withColumn(
            f"p{p}", lerp(F.col(f"_p{p}_lo"), F.col(f"_p{p}_hi"), h - F.floor(h))
        )
    extra_names = [c for c in sums.columns if c == "_k" or c.startswith("centroid")]
    return sums.select(
        "image_id",
        "n",
        *extra_names,
        "mean",
        F.sqrt("m2").alias("std"),
        F.col("m2").alias("var"),
        safe_div(F.col("m3"), F.pow("m2", F.lit(1.5))).alias("skewness"),
        (safe_div(F.col("m4"), F.col("m2") * F.col("m2")) - 3).alias("kurtosis"),
        *[f"p{p}" for p in STAT_PERCENTILES],
        (F.col("max") - F.col("min")).alias("range"),
        "min",
        "max",
        safe_div(F.sqrt("m2"), F.col("mean"), 0.0).alias("cv"),
        (F.col("p75") - F.col("p25")).alias("iqr"),
    )


def gray_histogram(counts: DataFrame, bins: int = 64) -> DataFrame:
    """Density histogram over [0, 255], zero bins included: (image_id, bin, c, density)."""
    width = 255.0 / bins
    filled = counts.groupBy(
        "image_id", F.least(F.floor(F.col("v") * bins / 255), F.lit(bins - 1)).alias("bin")
    ).agg(F.sum("c").alias("c"), (F.first("h") * F.first("w")).alias("n"))
    images = filled.groupBy("image_id").agg(
        F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m")
    )
    return images.select(
        "image_id", "n", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin")
    ).select(
        "image_id",
        F.col("bin").cast("int").alias("bin"),
        F.coalesce(F.col("m")[F.col("bin")], F.lit(0)).alias("c"),
        (F.coalesce(F.col("m")[F.col("bin")], F.lit(0)) / (F.col("n") * F.lit(width))).alias("density"),
    )


def histogram_summary(hist: DataFrame, bins: int = 64) -> DataFrame:
    """Mean, deviation, maximum, effective bins (over 1 % of the maximum) and entropies."""
    top = F.max("c").over(Window.partitionBy("image_id"))
    d = F.col("density")
    return (
        hist.withColumn("_top", top)
        .groupBy("image_id")
        .agg(
            F.avg(d).alias("hist_mean"),
            F.stddev_pop(d).alias("hist_std"),
            F.max(d).alias("hist_max"),
            F.sum((F.col("c") * 100 > F.col("_top")).cast("long")).alias("hist_effective_bins"),
            F.sum(entropy_term(d)).alias("entropy"),
        )
        .withColumn("entropy_norm", F.col("entropy") / F.lit(math.log2(bins)))
    )


def intensity_centroid(counts: DataFrame) -> DataFrame:
    """Relative intensity centroid; 0.5 for a black image."""
    total = F.sum(F.col("v") * F.col("c"))
    return counts.groupBy("image_id").agg(
        F.when(total == 0, F.lit(0.5))
        .otherwise(F.sum("cs") / total / F.first("w"))
        .alias("centroid_x"),
        F.when(total == 0, F.lit(0.5))
        .otherwise(F.sum("rs") / total / F.first("h"))
        .alias("centroid_y"),
    )


def gray_percentiles(tiles: DataFrame, percentiles) -> DataFrame:
    """(image_id, stat_pN...) by linear interpolation between ranks of the gray counts, at most 256 rows an image."""
    counts = gray_counts(tiles).groupBy("image_id", "v").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("image_id")
    upto = counts.withColumn("_u", F.sum("c").over(w.orderBy("v"))).withColumn("_n", F.sum("c").over(w))
    picks = []
    for p in percentiles:
        h = (F.col("_n") - 1) * (p / 100.0)
        for tag, rank in (("l", F.floor(h)), ("h", F.ceil(h))):
            picks.append(F.min(F.when(F.col("_u") > rank, F.col("v"))).cast("double").alias(f"_{tag}{p}"))
    found = upto.groupBy("image_id").agg(F.first("_n").alias("_n"), *picks)
    share = {p: (F.col("_n") - 1) * (p / 100.0) for p in percentiles}
    return found.select(
        "image_id", *[lerp(F.col(f"_l{p}"), F.col(f"_h{p}"), share[p] - F.floor(share[p])).alias(f"stat_p{p}") for p in percentiles]
    )


MOMENTS = ("mean", "std", "skewness", "kurtosis")


def stat_features(tiles: DataFrame, bins: int = 64, moments=MOMENTS, percentiles=None) -> DataFrame:
    """The stat_* columns, 86 with the usual settings, from one shuffle of gray counts and one pass over them.

    ``moments`` are any of mean, std, var, skewness and kurtosis. Percentiles other than the usual come from the same
    counts, interpolated between neighbouring ranks.
    """
    unknown = set(moments) - {*MOMENTS, "var"}
    wanted = STAT_PERCENTILES if percentiles is None else tuple(percentiles)
    if unknown or bins < 2 or any(not 0 <= p <= 100 for p in wanted):
        raise ValueError(f"no such moments, percentiles or bins: {', '.join(sorted(unknown)) or (wanted, bins)}")
    if tuple(moments) != MOMENTS or wanted != STAT_PERCENTILES:
        usual = stat_features(tiles, bins)
        dropped = [f"stat_{m}" for m in MOMENTS if m not in moments] + [f"stat_p{p}" for p in STAT_PERCENTILES if p not in wanted]
        out = usual.withColumn("stat_var", F.col("stat_std") * F.col("stat_std")) if "var" in moments else usual
        more = [p for p in wanted if p not in STAT_PERCENTILES]
        if more:
            out = out.join(gray_percentiles(tiles, more), "image_id")
        return out.drop(*dropped)
    slot = f"least(v * {bins} div 255, {bins - 1})"
    sums = ", ".join(f"sum(if({slot} = {k}, c, 0L))" for k in range(bins))
    centroid = "if(sum(v * c) = 0, 0.5D, sum({0}) / sum(v * c) / first({1})) AS centroid_{2}"
    extra = [
        F.expr(f"array({sums}) AS _k"),
        F.expr(centroid.format("cs", "w", "x")),
        F.expr(centroid.format("rs", "h", "y")),
    ]
    names = ["mean", "std", "skewness", "kurtosis"]
    names += [f"p{p}" for p in STAT_PERCENTILES] + ["range", "min", "max", "cv", "iqr"]
    return (
        count_moments(gray_counts(tiles), extra=extra)
        .selectExpr("*", f"transform(_k, x -> x * {bins / 255.0!r}D / n) AS _d")
        .selectExpr(
            "*",
            f"aggregate(_d, 0D, (a, x) -> a + x) / {bins} AS hist_mean",
            "array_max(_d) AS hist_max",
            "size(filter(_k, x -> x * 100 > array_max(_k))) AS hist_effective_bins",
            "aggregate(_d, 0D, (a, x) -> a + if(x > 0, -x * log2(x), 0D)) AS entropy",
        )
        .selectExpr(
            "image_id",
            *[f"CAST({n} AS DOUBLE) AS stat_{n}" for n in names],
            *[f"_d[{k}] AS stat_hist_bin_{k}" for k in range(bins)],
            "hist_mean AS stat_hist_mean",
            f"sqrt(aggregate(_d, 0D, (a, x) -> a + (x - hist_mean) * (x - hist_mean)) / {bins}) AS stat_hist_std",
            "hist_max AS stat_hist_max",
            "CAST(hist_effective_bins AS DOUBLE) AS stat_hist_effective_bins",
            "entropy AS stat_entropy",
            f"entropy / {math.log2(bins)!r}D AS stat_entropy_norm",
            "centroid_x AS stat_centroid_x",
            "centroid_y AS stat_centroid_y",
        )
    )
