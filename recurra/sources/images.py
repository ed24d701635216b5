"""Image files and tile tables."""

from __future__ import annotations

import struct
import zlib
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import BLOCK, map_rows
from ..operators.recurrence import TILE_SCHEMA, core
from .files import whole_file

# Luma weights of red, green and blue.
LUMA = (0.299, 0.587, 0.114)
EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif")


def list_images(spark, folder: str) -> DataFrame:
    """Files with an image extension: (path, filename, label)."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    )
    allowed = F.lower(F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1))).isin(*EXTENSIONS)
    return files.filter(allowed).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.element_at(F.split("path", "/"), -2).alias("label"),
    )


def image_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("label").agg(F.count(F.lit(1)).alias("c"))


def read_images(spark, folder: str, size: int = BLOCK, gray: str = "luma", smallest: int = 0) -> DataFrame:
    """Decode images with Spark's reader and cut them into tiles without halo.

    ``image_id`` is the file name. ``gray`` is 'luma' or 'mean'; ``smallest`` drops images with a
    shorter side. One file is one row, so this suits images under 2 GB; larger ones belong in a
    tile table.
    """
    rows = (
        spark.read.format("image")
        .option("dropInvalid", True)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(F.element_at(F.split("image.origin", "/"), -1).alias("image_id"), "image.height", "image.width", "image.nChannels", "image.data")
        .filter((F.col("height") >= smallest) & (F.col("width") >= smallest))
    )

    def kernel(row):
        px = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.nChannels)
        if row.nChannels == 1:
            flat = px[:, :, 0]
        else:
            rgb = px[:, :, 2::-1].astype(np.float64)
            flat = rgb.mean(axis=2) if gray == "mean" else np.rint(rgb @ np.asarray(LUMA))
            flat = flat.astype(np.uint8)
        return tile_arrays(flat, size)

    return map_rows(rows, "image_id", TILE_SCHEMA, kernel)


def tile_arrays(img: np.ndarray, size: int) -> dict[str, list]:
    """Columns of the tile table for one image without halo."""
    names = ("h", "w", "r0", "c0", "nr", "nc", "top", "left", "ph", "pw", "px")
    out = {name: [] for name in names}
    for r in range(0, img.shape[0], size):
        for c in range(0, img.shape[1], size):
            part = np.ascontiguousarray(img[r : r + size, c : c + size])
            values = (*img.shape, r, c, *part.shape, 0, 0, *part.shape, part.tobytes())
            for name, value in zip(names, values):
                out[name].append(value)
    return out


def shrink_tiles(tiles: DataFrame, factor: int) -> DataFrame:
    """Area-average down-scaling by a whole factor; tiles must start at its multiples.

    The last row and column average what is left of the image, so no pixel is dropped.
    """

    def kernel(row):
        px = core(row).astype(np.float64)
        if row.r0 % factor or row.c0 % factor:
            raise ValueError(f"a tile starts at ({row.r0}, {row.c0}), not at a multiple of {factor}")
        rows, columns = np.arange(0, px.shape[0], factor), np.arange(0, px.shape[1], factor)
        sums = np.add.reduceat(np.add.reduceat(px, rows, axis=0), columns, axis=1)
        high, wide = np.minimum(factor, px.shape[0] - rows), np.minimum(factor, px.shape[1] - columns)
        small = sums / (high[:, None] * wide)
        h, w = small.shape
        values = {
            "h": -(-row.h // factor), "w": -(-row.w // factor), "r0": row.r0 // factor, "c0": row.c0 // factor,
            "nr": h, "nc": w, "top": 0, "left": 0, "ph": h, "pw": w,
            "px": np.rint(small).astype(np.uint8).tobytes(),
        }
        return {k: [v] for k, v in values.items()}

    return map_rows(tiles, "image_id", TILE_SCHEMA, kernel)


def area_means(tiles: DataFrame, height: int | None = None, width: int | None = None, factor: float | None = None, size: int = BLOCK) -> DataFrame:
    """Images averaged down to height x width, or by any factor: (image_id, h, w, r0, c0, nr, nc, v), v as doubles.

    A target pixel is the mean of the source area it covers, edge pixels counted by the part that lies inside. Both
    directions are separable, so a tile adds its share to every target block it touches and needs no halo.
    """

    def shares(start: int, n: int, source: int, target: int) -> tuple[int, np.ndarray]:
        """First target position and the overlap of each target with each of the tile's pixels."""
        step = source / target
        first, last = int(start * target // source), min(target, -(-(start + n) * target // source))
        edges = np.arange(first, last + 1) * step
        at = np.arange(start, start + n)
        inside = np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at)
        return first, np.maximum(inside, 0) / step

    def kernel(row):
        goal_h = height if factor is None else max(1, int(row.h / factor))
        goal_w = width if factor is None else max(1, int(row.w / factor))
        if goal_h > row.h or goal_w > row.w:
            raise ValueError(f"{row.image_id} is smaller than {goal_h} x {goal_w}")
        top, down = shares(row.r0, row.nr, row.h, goal_h)
        left, across = shares(row.c0, row.nc, row.w, goal_w)
        part = down @ core(row).astype(np.float64) @ across.T
        out = {name: [] for name in ("h", "w", "r0", "c0", "nr", "nc", "top", "left", "ph", "pw", "v")}
        for r in range(top // size, (top + len(part) - 1) // size + 1):
            for c in range(left // size, (left + part.shape[1] - 1) // size + 1):
                rows = slice(max(r * size, top), min((r + 1) * size, top + len(part)))
                columns = slice(max(c * size, left), min((c + 1) * size, left + part.shape[1]))
                piece = part[rows.start - top : rows.stop - top, columns.start - left : columns.stop - left]
                extent = (min(size, goal_h - r * size), min(size, goal_w - c * size))
                values = (goal_h, goal_w, r * size, c * size, *extent, rows.start - r * size, columns.start - c * size, *piece.shape, np.ascontiguousarray(piece).tobytes())
                for name, value in zip(out, values):
                    out[name].append(value)
        return out

    schema = "h long, w long, r0 long, c0 long, nr int, nc int, top int, left int, ph int, pw int, v binary"
    parts = map_rows(tiles, "image_id", schema, kernel)

    def added(row):
        total = np.zeros((row.nr, row.nc))
        for p in row.parts:
            total[p["top"] : p["top"] + p["ph"], p["left"] : p["left"] + p["pw"]] += np.frombuffer(p["v"]).reshape(p["ph"], p["pw"])
        return {**{c: [getattr(row, c)] for c in ("h", "w", "r0", "c0", "nr", "nc")}, "v": [total.tobytes()]}

    piece = F.array_sort(F.collect_list(F.struct("top", "left", "ph", "pw", "v"))).alias("parts")
    heads = [F.first(c).alias(c) for c in ("h", "w", "nr", "nc")]
    gathered = parts.groupBy("image_id", "r0", "c0").agg(*heads, piece)
    return map_rows(gathered, "image_id", "h long, w long, r0 long, c0 long, nr int, nc int, v binary", added)


def resize_tiles(tiles: DataFrame, height: int | None = None, width: int | None = None, factor: float | None = None, size: int = BLOCK) -> DataFrame:
    """The tile table of images averaged down to a size or by any factor; means are rounded to whole gray levels."""

    def kernel(row):
        px = np.clip(np.rint(np.frombuffer(row.v)), 0, 255).astype(np.uint8)
        values = {c: getattr(row, c) for c in ("h", "w", "r0", "c0", "nr", "nc")}
        values |= {"top": 0, "left": 0, "ph": row.nr, "pw": row.nc, "px": px.tobytes()}
        return {k: [v] for k, v in values.items()}

    return map_rows(area_means(tiles, height, width, factor, size), "image_id", TILE_SCHEMA, kernel)


def fit_tiles(tiles: DataFrame, largest: int = 25000, size: int = BLOCK) -> DataFrame:
    """Images with a side beyond the limit are averaged down until both fit, proportions kept; others pass as they are."""
    shape = F.greatest(F.col("h"), F.col("w"))
    big = tiles.filter(shape > largest)
    small = tiles.filter(shape <= largest)
    sizes = big.select("h", "w").distinct().collect()  # image sizes, not images
    for row in sizes:
        scale = min(largest / row.h, largest / row.w)
        own = big.filter((F.col("h") == row.h) & (F.col("w") == row.w))
        small = small.unionByName(resize_tiles(own, max(1, int(row.h * scale)), max(1, int(row.w * scale)), size=size))
    return small


def validate_tiles(tiles: DataFrame) -> DataFrame:
    """(image_id, pixels, valid, problem) of every image: its tiles cover each of its pixels once and hold their bytes.

    An image without height or width is empty; a null or short byte array, tiles that overlap, lie outside or leave
    gaps are the other problems.
    """
    area = F.col("nr").cast("long") * F.col("nc")
    inside = (F.col("r0") >= 0) & (F.col("c0") >= 0) & (F.col("r0") + F.col("nr") <= F.col("h")) & (F.col("c0") + F.col("nc") <= F.col("w"))
    held = F.coalesce(F.octet_length("px") == F.col("ph") * F.col("pw"), F.lit(False))
    core_held = (F.col("top") >= 0) & (F.col("left") >= 0) & (F.col("top") + F.col("nr") <= F.col("ph")) & (F.col("left") + F.col("nc") <= F.col("pw"))
    by_image = tiles.groupBy("image_id").agg(
        F.max("h").alias("h"), F.max("w").alias("w"), F.coalesce(F.sum(area), F.lit(0)).alias("pixels"),
        F.bool_and((F.col("nr") > 0) & (F.col("nc") > 0)).alias("_some"), F.bool_and(inside).alias("_inside"), F.bool_and(held & core_held).alias("_held"),
        (F.count_distinct("h", "w") == 1).alias("_one"), (F.count_distinct("r0", "c0") == F.count(F.lit(1))).alias("_once"),
    )
    problem = (
        F.when(F.coalesce((F.col("h") <= 0) | (F.col("w") <= 0), F.lit(True)), "empty")
        .when(~F.col("_one"), "several sizes")
        .when(~F.col("_held") | ~F.col("_some"), "pixels missing")
        .when(~F.col("_inside"), "outside the image")
        .when(~F.col("_once") | (F.col("pixels") > F.col("h") * F.col("w")), "pixels twice")
        .when(F.col("pixels") < F.col("h") * F.col("w"), "gaps")
    )
    return by_image.select("image_id", "pixels", problem.isNull().alias("valid"), problem.alias("problem"))


def validate_arrays(images: DataFrame) -> DataFrame:
    """Add ``problem`` to images(shape array, px array of doubles): null if two-dimensional, not empty and finite."""
    finite = F.forall("px", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return images.withColumn(
        "problem",
        F.when(F.col("px").isNull() | F.col("shape").isNull(), "missing")
        .when(F.size("shape") != 2, "not two-dimensional")
        .when((F.size("px") == 0) | F.exists("shape", lambda n: n <= 0), "empty")
        .when(F.size("px") != F.get("shape", F.lit(0)) * F.get("shape", F.lit(1)), "pixels missing")
        .when(~finite, "not finite"),
    )


# --- PNG files -----------------------------------------------------------------------------------


def _chunk(tag: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))


def joined_adler(first: int, second: int, length: int) -> int:
    """Adler-32 of two byte strings one after the other, from both checksums and the length of the second."""
    base = 65521
    low = ((first & 0xFFFF) + (second & 0xFFFF) - 1) % base
    high = ((first >> 16) + (second >> 16) + length * ((first & 0xFFFF) - 1)) % base
    return high << 16 | low


def strips(tiles: DataFrame) -> DataFrame:
    """(image_id, h, w, r0, adler, length, body): each row of tiles deflated on its own, ended by a flush.

    Tiles that start at the same row form a strip as wide as the image; strips are independent and can be appended.
    """
    kind = tiles.schema["image_id"].dataType.simpleString()

    def deflate(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        lines = np.zeros((first.nr, first.w + 1), dtype=np.uint8)  # a filter byte of 0 leads each line
        for row in pdf.itertuples(index=False):
            lines[:, 1 + row.c0 : 1 + row.c0 + row.nc] = core(row)
        data = lines.tobytes()
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        last = first.r0 + first.nr == first.h
        body = packer.compress(data) + packer.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)
        head = {c: [first[c]] for c in ("image_id", "h", "w", "r0")}
        return pd.DataFrame({**head, "adler": [zlib.adler32(data)], "length": [len(data)], "body": [body]})

    return tiles.groupBy("image_id", "r0").applyInPandas(deflate, f"image_id {kind}, h long, w long, r0 long, adler long, length long, body binary")


def write_png(tiles: DataFrame, folder: str) -> DataFrame:
    """One 8-bit grayscale PNG per image, named image.png: (image_id, path).

    Strips are compressed in parallel; a task then appends an image's strips in order, one at a time, so an image need
    not fit in memory. ``folder`` may be a URI; a file appears when it is complete.
    """
    ready = strips(tiles).repartition("image_id").sortWithinPartitions("image_id", "r0")

    def run(batches):
        def rows():
            for pdf in batches:
                yield from pdf.itertuples(index=False)

        for image_id, own in groupby(rows(), key=lambda row: row.image_id):
            target = f"{folder.rstrip('/')}/{image_id}.png"
            with whole_file(target) as out:
                adler, at = 1, 0
                for row in own:
                    if row.r0 != at:
                        raise ValueError(f"image {image_id} has no rows from {at} to {row.r0}")
                    if at == 0:
                        header = struct.pack(">IIBBBBB", row.w, row.h, 8, 0, 0, 0, 0)
                        out.write(b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", header) + _chunk(b"IDAT", b"\x78\x9c"))
                    out.write(_chunk(b"IDAT", row.body))
                    adler = joined_adler(adler, row.adler, row.length)
                    at += row.length // (row.w + 1)
                if at != row.h:
                    raise ValueError(f"image {image_id} ends at row {at} of {row.h}")
                out.write(_chunk(b"IDAT", struct.pack(">I", adler)) + _chunk(b"IEND", b""))
            yield pd.DataFrame({"image_id": [str(image_id)], "path": [target]})

    return ready.mapInPandas(run, "image_id string, path string")
