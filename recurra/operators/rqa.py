"""Recurrence quantification of image tiles.

A tile reports its inner runs as counts per length and the runs that touch its border as
segments. Segments of one line meet again in a window, so no task sees a whole line of pixels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entropy_term, safe_div
from ..session import stage
from .blocks import map_rows, spread
from .recurrence import core

RQA_NAMES = ("RR", "DET", "LAM", "ENTR", "L_max", "L_mean", "V_max", "V_mean", "TT", "DIV")


def gray_threshold(counts: DataFrame, percent: float = 10.0) -> DataFrame:
    """Percentile of the pixel values of each image from its gray counts: (image_id, level)."""
    whole = Window.partitionBy("image_id")
    cum = counts.withColumn("n", F.sum("c").over(whole)).withColumn(
        "cum", F.sum("c").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    )
    h = (F.col("n") - 1) * F.lit(percent / 100.0)
    low = F.min(F.when(F.col("cum") > F.floor(h), F.col("v")))
    high = F.min(F.when(F.col("cum") > F.ceil(h), F.col("v")))
    share = F.first(h - F.floor(h))
    return cum.groupBy("image_id").agg((low + (high - low) * share).alias("level"))


def _line_runs(lines: np.ndarray, start: np.ndarray, valid: np.ndarray):
    """Runs of ones along the rows of ``lines``: (line, start, length, touches_border)."""
    padded = np.zeros((lines.shape[0], lines.shape[1] + 2), dtype=np.int8)
    padded[:, 1:-1] = lines
    step = np.diff(padded, axis=1)
    line, begin = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    touching = (begin == 0) | (end == valid[line])
    return line, start[line] + begin, end - begin, touching


def _diagonals(img: np.ndarray):
    """Diagonals of a matrix as left-aligned rows, with their offsets and lengths."""
    h, w = img.shape
    offsets = np.arange(-(h - 1), w)
    first_r, first_c = np.maximum(0, -offsets), np.maximum(0, offsets)
    lengths = np.minimum(h - first_r, w - first_c)
    out = np.zeros((len(offsets), min(h, w)), dtype=np.int8)
    r, c = np.nonzero(img)
    k = c - r + (h - 1)
    out[k, np.minimum(r, c)] = 1
    # nonzero cells start at the diagonal's first cell: min(r, c) counts from there
    return out, offsets, first_r, lengths


def recurrence_runs(
    tiles: DataFrame, level: DataFrame, symmetric: bool = True, keep_main: bool = False
) -> DataFrame:
    """Run lengths of recurrent pixels (value <= level): (image_id, side, dir, len, c).

    ``dir`` is 'd' (diagonals off the main one), 'v' (columns) or 'n' (len = 1, c = the number of
    recurrent pixels). ``symmetric`` joins each tile with its mirror tile and takes the union.
    """
    leveled = tiles.join(level, "image_id").select(
        "image_id", "h", "r0", "c0", "nr", "nc", "top", "left", "ph", "pw", "px", "level"
    )
    if symmetric:
        mirror = tiles.select(
            "image_id",
            F.col("c0").alias("r0"),
            F.col("r0").alias("c0"),
            *[F.col(c).alias(f"t_{c}") for c in ("nr", "nc", "top", "left", "ph", "pw", "px")],
        )
        keys = ["image_id", "r0", "c0"]
        leveled = spread(leveled, *keys).join(spread(mirror, *keys), keys)

    def kernel(row):
        img = core(row) <= row.level
        if symmetric:
            other = np.frombuffer(row.t_px, dtype=np.uint8).reshape(row.t_ph, row.t_pw)
            other = other[row.t_top : row.t_top + row.t_nr, row.t_left : row.t_left + row.t_nc]
            img = img | (other <= row.level).T
        out = {"dir": ["n"], "line": [0], "s": [0], "len": [1], "c": [int(img.sum())]}

        def add(tag, line, start, length, touching):
            sizes = np.bincount(length[~touching])
            used = np.flatnonzero(sizes)
            edge = np.flatnonzero(touching)
            out["dir"] += [tag] * (len(used) + len(edge))
            out["line"] += [0] * len(used) + line[edge].tolist()
            out["s"] += [-1] * len(used) + start[edge].tolist()
            out["len"] += used.tolist() + length[edge].tolist()
            out["c"] += sizes[used].tolist() + [1] * len(edge)

        diag, offsets, first_r, lengths = _diagonals(img)
        line, start, length, touching = _line_runs(diag, row.r0 + first_r, lengths)
        number = offsets[line] + row.c0 - row.r0
        keep = np.ones(len(line), dtype=bool) if keep_main else number != 0
        add("d", number[keep], start[keep], length[keep], touching[keep])
        line, start, length, touching = _line_runs(
            img.T, np.full(row.nc, row.r0), np.full(row.nc, row.nr)
        )
        add("v", line + row.c0, start, length, touching)
        size = len(out["c"])
        return {"side": np.full(size, row.h), **{k: np.asarray(v) for k, v in out.items()}}

    pieces = map_rows(
        leveled, "image_id", "side long, dir string, line long, s long, len long, c long", kernel
    ).groupBy("image_id", "side", "dir", "line", "s", "len").agg(F.sum("c").alias("c"))
    # Inner runs (s < 0) and the pixel count keep to themselves; border segments chain up per line.
    alone = (F.col("s") < 0) | (F.col("dir") == "n")
    w = Window.partitionBy("image_id", "side", "dir", "line", "apart").orderBy("s")
    return (
        pieces.withColumn("apart", F.when(alone, F.col("len")).otherwise(F.lit(0)))
        .withColumn("_new", F.coalesce((F.col("s") != F.lag(F.col("s") + F.col("len")).over(w)).cast("int"), F.lit(1)))
        .withColumn("_gid", F.when(alone, F.lit(0)).otherwise(F.sum("_new").over(w)))
        .groupBy("image_id", "side", "dir", "line", "apart", "_gid")
        .agg(
            F.when(F.col("apart") > 0, F.max("len")).otherwise(F.sum("len")).alias("len"),
            F.sum(F.when(F.col("apart") > 0, F.col("c")).otherwise(0)).alias("_inner"),
        )
        .groupBy("image_id", "side", "dir", "len")
        .agg(
            F.sum(F.when(F.col("apart") > 0, F.col("_inner")).otherwise(1)).alias("c"),
        )
    )


def rqa_measures(runs: DataFrame, l_min: int = 2) -> DataFrame:
    """The ten measures from run-length counts: (image_id, rqa_*). DIV is NULL without diagonals."""
    long_run = F.col("len") >= l_min
    c = F.col("c").cast("double")

    def pick(tag, value, extra=long_run):
        return F.when((F.col("dir") == tag) & extra, value)

    whole = Window.partitionBy("image_id")
    runs = runs.withColumn("_dn", F.sum(pick("d", c)).over(whole))
    sums = runs.groupBy("image_id").agg(
        F.first("side").alias("side"),
        F.coalesce(F.sum(pick("n", c, F.lit(True))), F.lit(0.0)).alias("ones"),
        *[
            F.coalesce(expr, F.lit(0.0)).alias(name)
            for name, expr in {
                "d_mass": F.sum(pick("d", c * F.col("len"))),
                "d_count": F.sum(pick("d", c)),
                "d_max": F.max(pick("d", F.col("len").cast("double"))),
                "v_mass": F.sum(pick("v", c * F.col("len"))),
                "v_count": F.sum(pick("v", c)),
                "v_max": F.max(pick("v", F.col("len").cast("double"))),
                "entr": F.sum(pick("d", entropy_term(c / F.col("_dn")))),
            }.items()
        ],
    )
    ones = F.greatest(F.col("ones"), F.lit(1.0))
    v_mean = safe_div(F.col("v_mass"), F.col("v_count"), 0.0)
    return sums.select(
        "image_id",
        (F.col("ones") / (F.col("side") * F.col("side"))).alias("rqa_RR"),
        (F.col("d_mass") / ones).alias("rqa_DET"),
        (F.col("v_mass") / ones).alias("rqa_LAM"),
        F.col("entr").alias("rqa_ENTR"),
        F.col("d_max").alias("rqa_L_max"),
        safe_div(F.col("d_mass"), F.col("d_count"), 0.0).alias("rqa_L_mean"),
        F.col("v_max").alias("rqa_V_max"),
        v_mean.alias("rqa_V_mean"),
        v_mean.alias("rqa_TT"),
        safe_div(F.lit(1.0), F.col("d_max")).alias("rqa_DIV"),
    )


def rqa_features(
    tiles: DataFrame,
    percent: float = 10.0,
    l_min: int = 2,
    epsilon: float | None = None,
    symmetric: bool = True,
) -> DataFrame:
    """rqa_* columns of square images. Images under ten pixels a side are undefined: all zero.

    ``epsilon`` is a fixed threshold on pixel / 255; otherwise the percentile of the image's own
    pixels is used.
    """
    from .recurrence import gray_counts

    if epsilon is None:
        level = stage(gray_threshold(gray_counts(tiles), percent))
    else:
        level = tiles.select("image_id").distinct().withColumn("level", F.lit(epsilon * 255.0))
    measures = rqa_measures(recurrence_runs(tiles, level, symmetric), l_min)
    small = tiles.select("image_id", (F.least("h", "w") < 10).alias("_small")).distinct()
    joined = measures.join(small, "image_id")
    return joined.select(
        "image_id",
        *[
            F.when(F.col("_small"), F.lit(None if n == "DIV" else 0.0))
            .otherwise(F.col(f"rqa_{n}"))
            .alias(f"rqa_{n}")
            for n in RQA_NAMES
        ],
    )
