"""Recurrence matrices as tiles: distances, threshold, grayscale and binary images.

A tile row of the image table is
``image_id, h, w, r0, c0, nr, nc, top, left, ph, pw, px``: the core rectangle starts at
(r0, c0) with size (nr, nc); ``px`` holds ph*pw pixels (core plus halo), row-major uint8, and the
core starts at (top, left) inside it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .blocks import BLOCK, block_pairs, delay_vectors, map_rows, pair_distance, signal_blocks
from .chunks import quantiles_inside, wanted_bins
from .leaves import farthest, repeats, squares

EPSILON_BINS, EPSILON_LEVELS = 4096, 5
EPSILON_LISTED = 1 << 16  # most distances of a bin whose values are listed
LEVEL_SIDE, WIDEST = 16, 1 << 17  # blocks along a side before they grow, and the most samples of a block
LEVEL_ROWS = 32  # vectors that meet a strip of others at a time, so that distances stay in the cache
TILE_SCHEMA = (
    "h long, w long, r0 long, c0 long, nr int, nc int, top int, left int, ph int, pw int, px binary"
)


def _pairs(signal, m, tau, size, upper=True, halo=0, flip=False, per_signal=None, carry=None):
    """Tile rows with the samples of both sides; ``per_signal`` adds scalars before replication."""
    lost = (m - 1) * tau
    cols = signal_blocks(signal, size, halo, halo + lost, lost)
    rows = signal_blocks(signal, size, halo, halo + lost, lost, reverse=True) if flip else cols
    if per_signal is not None:
        rows = rows.join(per_signal, "signal_id")
    return block_pairs(rows, cols, size, lost, upper, carry)


def _tile_distance(row, m, tau, flip=False):
    return pair_distance(
        delay_vectors(np.asarray(row.r_y), m, tau, flip), delay_vectors(np.asarray(row.c_y), m, tau)
    )


def _above_diagonal(row, dist):
    """Distances of unordered point pairs held by an upper tile without halo."""
    return dist[np.triu_indices(dist.shape[0], 1)] if row.br == row.bc else dist.ravel()


def distance_summary(signal: DataFrame, m: int, tau: int, size: int = BLOCK) -> DataFrame:
    """(signal_id, pairs, d_max, d_sum) over all unordered point pairs."""

    def kernel(row):
        d = _above_diagonal(row, _tile_distance(row, m, tau))
        return {"pairs": [d.size], "d_max": [d.max(initial=0.0)], "d_sum": [d.sum()]}

    return (
        map_rows(
            _pairs(signal, m, tau, size), "signal_id", "pairs long, d_max double, d_sum double", kernel
        )
        .groupBy("signal_id")
        .agg(F.sum("pairs").alias("pairs"), F.max("d_max").alias("d_max"), F.sum("d_sum").alias("d_sum"))
    )


def _bins_along(d: np.ndarray, d_max: float, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The distances that lie in the bin a path names, and their bins inside it.

    A path is one five-digit bin number per level. Every step is monotone in the distance, so paths sort like distances.
    """
    x = d / d_max * EPSILON_BINS if d_max > 0 else np.zeros(d.size)
    own = np.minimum(x.astype(np.int64), EPSILON_BINS - 1)
    for k in range(0, len(path), 5):
        keep = np.flatnonzero(own == int(path[k : k + 5]))
        d, x = d[keep], (x[keep] - own[keep]) * EPSILON_BINS
        own = np.minimum(x.astype(np.int64), EPSILON_BINS - 1)
    return d, own


def epsilon_percentile(
    signal: DataFrame, m: int, tau: int, percent: float = 10.0, size: int = BLOCK, listed: int | None = None
) -> DataFrame:
    """Exact percentile of the pair distances: (signal_id, n, eps), n the number of pairs.

    One pass builds a histogram per signal. While a bin that holds a wanted rank has more than ``listed`` distances and
    they differ, a further pass cuts it into as many bins again, down to the last digit of a distance. Only then are
    the distinct distances of these bins returned. The small tables between passes are staged.
    """
    listed = EPSILON_LISTED if listed is None else listed
    probs = {"eps": percent / 100.0}
    top = stage(distance_summary(signal, m, tau, size).select("signal_id", "d_max", "pairs"))
    zero = F.lit(0).cast("long")
    wanted = top.select(
        "signal_id", F.lit("").alias("_bin"), zero.alias("_before"), F.col("pairs").alias("n"), F.col("pairs").alias("_c"), F.lit(True).alias("_wide")
    )

    def per_signal(bins: DataFrame) -> DataFrame:
        return bins.groupBy("signal_id").agg(F.array_sort(F.collect_list("_bin")).alias("bins")).join(top, "signal_id")

    def histogram(row):
        d, out = _above_diagonal(row, _tile_distance(row, m, tau)), []
        for path in row.bins:
            inside, own = _bins_along(d, row.d_max, path)
            order = np.argsort(own, kind="stable")
            used, first, counts = np.unique(own[order], return_index=True, return_counts=True)
            if len(used):
                values = inside[order]
                low, high = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
                out.append((np.full(len(used), path, dtype=object), used, counts, low, high))
        if not out:
            return None
        return dict(zip(("_of", "_sub", "_c", "_low", "_high"), map(np.concatenate, zip(*out))))

    for level in range(EPSILON_LEVELS):
        wide = wanted.filter("_wide")
        if level and wide.isEmpty():
            break
        tiles = _pairs(signal, m, tau, size, per_signal=per_signal(wide), carry=["d_max", "bins"])
        counts = (
            map_rows(tiles, "signal_id", "_of string, _sub long, _c long, _low double, _high double", histogram)
            .groupBy("signal_id", "_of", "_sub")
            .agg(F.sum("_c").alias("_c"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
            .join(wide.select("signal_id", F.col("_bin").alias("_of"), F.col("_before").alias("_base"), "n"), ["signal_id", "_of"])
            .withColumn("_bin", F.concat("_of", F.lpad(F.col("_sub").cast("string"), 5, "0")))
        )
        hit = wanted_bins(counts, "signal_id", probs, base="_base")
        sizes = counts.select("signal_id", "_bin", "_c", ((F.col("_c") > listed) & (F.col("_high") > F.col("_low"))).alias("_wide"))
        finer = hit.join(sizes, ["signal_id", "_bin"])
        wanted = stage(finer if level == 0 else wanted.filter("NOT _wide").unionByName(finer))

    def members(row):
        d, out = _above_diagonal(row, _tile_distance(row, m, tau)), []
        for path in row.bins:
            values, counts = np.unique(_bins_along(d, row.d_max, path)[0], return_counts=True)
            out.append((np.full(len(values), path, dtype=object), values, counts))
        return dict(zip(("_bin", "_v", "_c"), map(np.concatenate, zip(*out))))

    inside = (
        map_rows(
            _pairs(signal, m, tau, size, per_signal=per_signal(wanted), carry=["d_max", "bins"]),
            "signal_id",
            "_bin string, _v double, _c long",
            members,
        )
        .groupBy("signal_id", "_bin", "_v")
        .agg(F.sum("_c").alias("_c"))
        .join(wanted.select("signal_id", "_bin", "_before", "n"), ["signal_id", "_bin"])
    )
    return quantiles_inside(inside, "signal_id", probs)


def recurrence_tiles(
    signal: DataFrame,
    m: int = 7,
    tau: int = 9,
    binary: bool = False,
    epsilon: float | None = None,
    percent: float = 10.0,
    flip: bool = True,
    halo: int = 0,
    size: int = BLOCK,
) -> DataFrame:
    """The recurrence image of every signal, cut into tiles (image_id = signal_id).

    Grayscale: trunc(255 * d / max d). Binary: 0 where recurrent, 255 elsewhere, with a fixed
    epsilon or a percentile of the distances. ``flip`` stores the image bottom row first. The
    scale of each image takes a pass of its own, whose small result is staged: from the written
    table's size Spark knows whether it can be broadcast.
    """
    if binary and epsilon is None:
        level = epsilon_percentile(signal, m, tau, percent, size).select(
            "signal_id", F.col("eps").alias("level")
        )
    elif binary:
        level = signal.select("signal_id").distinct().withColumn("level", F.lit(float(epsilon)))
    else:
        level = distance_summary(signal, m, tau, size).select(
            "signal_id", F.col("d_max").alias("level")
        )
    level = stage(level)
    lost = (m - 1) * tau

    def kernel(row):
        dist = _tile_distance(row, m, tau, flip)
        if binary:
            px = np.where(dist <= row.level, np.uint8(0), np.uint8(255))
        elif row.level > 0:
            dist /= row.level
            dist *= 255
            px = dist.astype(np.uint8)  # truncates
        else:
            px = np.zeros(dist.shape, dtype=np.uint8)
        side = row.n - lost
        r0, c0 = row.br * size, row.bc * size
        return {
            "h": [side],
            "w": [side],
            "r0": [r0],
            "c0": [c0],
            "nr": [min(size, side - r0)],
            "nc": [min(size, side - c0)],
            "top": [r0 - row.r_start],
            "left": [c0 - row.c_start],
            "ph": [px.shape[0]],
            "pw": [px.shape[1]],
            "px": [px.tobytes()],
        }

    pairs = _pairs(signal, m, tau, size, False, halo, flip, level, ["level"])
    return map_rows(pairs, "signal_id", TILE_SCHEMA, kernel).withColumnRenamed("signal_id", "image_id")


def pixels(row) -> np.ndarray:
    """Pixel array of a tile row, halo included."""
    return np.frombuffer(row.px, dtype=np.uint8).reshape(row.ph, row.pw)


def core(row) -> np.ndarray:
    """Pixel array of a tile row without the halo."""
    return pixels(row)[row.top : row.top + row.nr, row.left : row.left + row.nc]


def assemble_tiles(parts: DataFrame) -> DataFrame:
    """Tiles from rectangles of pixels.

    parts: image_id, h, w, the tile's core (r0, c0, nr, nc), its halo, and a rectangle (sr, sc, sh, sw, px) of the
    image, one row each. Rectangles may overlap but together must cover every tile, else the kernel raises.
    """

    def assemble(row):
        top, left = min(row.halo, row.r0), min(row.halo, row.c0)
        ph = top + row.nr + min(row.halo, row.h - row.r0 - row.nr)
        pw = left + row.nc + min(row.halo, row.w - row.c0 - row.nc)
        px, known = np.zeros((ph, pw), dtype=np.uint8), np.zeros((ph, pw), dtype=bool)
        for s in row.parts:
            part = np.frombuffer(s["px"], dtype=np.uint8).reshape(s["sh"], s["sw"])
            y, x = s["sr"] - (row.r0 - top), s["sc"] - (row.c0 - left)
            part = part[max(0, -y) : ph - y, max(0, -x) : pw - x]
            y, x = max(0, y), max(0, x)
            px[y : y + part.shape[0], x : x + part.shape[1]] = part
            known[y : y + part.shape[0], x : x + part.shape[1]] = True
        if not known.all():
            raise ValueError(f"{(~known).sum()} pixels of the tile at ({row.r0}, {row.c0}) are missing")
        return {
            "h": [row.h], "w": [row.w], "r0": [row.r0], "c0": [row.c0], "nr": [row.nr], "nc": [row.nc],
            "top": [top], "left": [left], "ph": [ph], "pw": [pw], "px": [px.tobytes()],
        }

    gathered = parts.groupBy("image_id", "h", "w", "r0", "c0", "nr", "nc", "halo").agg(
        F.collect_list(F.struct("sr", "sc", "sh", "sw", "px")).alias("parts")
    )
    return map_rows(gathered, "image_id", TILE_SCHEMA, assemble)


PARTS = "h long, w long, r0 long, c0 long, nr int, nc int, halo int, sr long, sc long, sh int, sw int, px binary"


def rectangle(img: np.ndarray, r0: int, c0: int, low: tuple, high: tuple) -> dict | None:
    """The part of a tile's core at (r0, c0) between two corners of the image."""
    a, b = max(r0, low[0]), min(r0 + img.shape[0], high[0])
    c, d = max(c0, low[1]), min(c0 + img.shape[1], high[1])
    if a >= b or c >= d:
        return None
    px = np.ascontiguousarray(img[a - r0 : b - r0, c - c0 : d - c0])
    return {"sr": a, "sc": c, "sh": b - a, "sw": d - c, "px": px.tobytes()}


def with_halo(tiles: DataFrame, halo: int) -> DataFrame:
    """Give tiles a halo by sending strips to every tile that the halo reaches, however many steps away.

    Expects tiles on a regular grid; only the strips and the cores are shuffled.
    """

    def strips(row):
        img, out = core(row), []
        far_r, far_c = -(-halo // row.step_r), -(-halo // row.step_c)
        for to_r in range(row.r0 - far_r * row.step_r, row.r0 + far_r * row.step_r + 1, row.step_r):
            for to_c in range(row.c0 - far_c * row.step_c, row.c0 + far_c * row.step_c + 1, row.step_c):
                if not (0 <= to_r < row.h and 0 <= to_c < row.w):
                    continue
                nr, nc = min(row.step_r, row.h - to_r), min(row.step_c, row.w - to_c)
                part = rectangle(img, row.r0, row.c0, (to_r - halo, to_c - halo), (to_r + nr + halo, to_c + nc + halo))
                if part:
                    out.append({"h": row.h, "w": row.w, "r0": to_r, "c0": to_c, "nr": nr, "nc": nc, "halo": halo, **part})
        return {name: [part[name] for part in out] for name in out[0]}

    grid = tiles.groupBy("image_id").agg(F.max("nr").alias("step_r"), F.max("nc").alias("step_c"))
    return assemble_tiles(map_rows(tiles.join(grid, "image_id"), "image_id", PARTS, strips))


def image_rows(tiles: DataFrame) -> DataFrame:
    """Per image row: pixel sum and column-weighted pixel sum (image_id, r, s, ws)."""

    def kernel(row):
        px = core(row).astype(np.int64)
        cols = np.arange(row.c0, row.c0 + row.nc)
        return {"r": np.arange(row.r0, row.r0 + row.nr), "s": px.sum(axis=1), "ws": px @ cols}

    return (
        map_rows(tiles, "image_id", "r long, s long, ws long", kernel)
        .groupBy("image_id", "r")
        .agg(F.sum("s").alias("s"), F.sum("ws").alias("ws"))
    )


def gray_counts(tiles: DataFrame) -> DataFrame:
    """256-bin counts and intensity moments: (image_id, h, w, v, c, rs, cs).

    ``rs`` and ``cs`` add up, over an image's rows of this table, to the sums of row * pixel and
    column * pixel; so every first-order feature, the centroids included, follows from at most 256
    rows per image.
    """

    def kernel(row):
        px = core(row)
        counts = np.bincount(px.ravel(), minlength=256)
        used = np.flatnonzero(counts)
        moments = np.zeros((2, len(used)), dtype=np.int64)
        moments[0, 0] = px.sum(axis=1, dtype=np.int64) @ np.arange(row.r0, row.r0 + row.nr)
        moments[1, 0] = px.sum(axis=0, dtype=np.int64) @ np.arange(row.c0, row.c0 + row.nc)
        return {
            "h": np.full(len(used), row.h),
            "w": np.full(len(used), row.w),
            "v": used,
            "c": counts[used],
            "rs": moments[0],
            "cs": moments[1],
        }

    return (
        map_rows(tiles, "image_id", "h long, w long, v int, c long, rs long, cs long", kernel)
        .groupBy("image_id", "v")
        .agg(
            F.first("h").alias("h"),
            F.first("w").alias("w"),
            F.sum("c").alias("c"),
            F.sum("rs").alias("rs"),
            F.sum("cs").alias("cs"),
        )
    )


def gray_levels(signal: DataFrame, m: int, tau: int, size: int | None = None) -> DataFrame:
    """Pixels per gray level of every recurrence image, (image_id, v, c), without making the image.

    Equal delay vectors of a block are taken once, with their number, and a pair for its mirror too: an image is
    symmetric but for the flip, which moves pixels only. The largest distance is looked for in boxes of vectors. Without
    ``size`` the blocks grow with the longest series, so that each is copied a bounded number of times.
    """
    lost = (m - 1) * tau
    longest = signal.agg(F.max("n")).first()[0] or 0 if size is None else 0
    size = size or min(max(BLOCK, -(-longest // LEVEL_SIDE)), WIDEST)

    def sides(row):
        for y, b in ((row.r_y, row.br), (row.c_y, row.bc)):
            yield repeats(np.asarray(y), m, tau, min(size, row.n - lost - b * size))

    def furthest(row):
        (p, _), (q, _) = sides(row)
        return {"top": [np.sqrt(farthest(p, q))]}

    def count(row):
        (p, rows), (q, cols) = sides(row)
        if row.br == row.bc:
            return {"v": np.arange(256), "c": _levels(p, rows, p, rows, row.level)}
        return {"v": np.arange(256), "c": 2 * _levels(p, rows, q, cols, row.level)}

    tops = map_rows(_pairs(signal, m, tau, size), "signal_id", "top double", furthest)
    level = stage(tops.groupBy("signal_id").agg(F.max("top").alias("level")))
    pairs = _pairs(signal, m, tau, size, per_signal=level, carry=["level"])
    return (
        map_rows(pairs, "signal_id", "v int, c long", count)
        .groupBy(F.col("signal_id").alias("image_id"), "v")
        .agg(F.sum("c").alias("c"))
        .filter("c > 0")
    )


def _levels(p: np.ndarray, rows: np.ndarray, q: np.ndarray, cols: np.ndarray, level: float, wide: int = 4096) -> np.ndarray:
    """Number of pairs per gray level of vectors p and q, which stand for ``rows`` and ``cols`` vectors each."""
    counts = np.zeros(256, dtype=np.int64)
    once = bool((rows == 1).all() and (cols == 1).all())
    for top in range(0, len(p), LEVEL_ROWS):
        for left in range(0, len(q), wide):
            part, other = slice(top, top + LEVEL_ROWS), slice(left, left + wide)
            dist = np.sqrt(squares(p[part], q[other]))
            if level > 0:
                dist /= level
                dist *= 255
            else:
                dist[:] = 0
            px = dist.astype(np.uint8).ravel()  # truncates
            if once:
                counts += np.bincount(px, minlength=256)
            else:
                counts += np.bincount(px, np.outer(rows[part], cols[other]).ravel(), 256).astype(np.int64)
    return counts


def phase_space(signal: DataFrame, m: int, tau: int) -> DataFrame:
    """Trajectory coordinates for 2 or 3 dimensions."""
    from .params import takens

    if m not in (2, 3):
        raise ValueError("a phase portrait needs two or three dimensions")
    return takens(signal, m, tau)


def image_name(label, base, normal: str = "Normal"):
    """Output name: class prefix, base name, fixed suffix."""
    return F.concat(F.when(label == normal, F.lit("n_")).otherwise(F.lit("p_")), base, F.lit("_rp_pure.png"))
