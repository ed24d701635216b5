"""WAV files: listing, header scan, decoding to sample blocks, encoding."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import whole_file

SAMPLES_PER_BLOCK = 65536


def list_audio(spark, folder: str) -> DataFrame:
    """WAV files below a folder: (path, label = parent folder, modificationTime, length, content)."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.wav")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return files.withColumn("label", F.element_at(F.split("path", "/"), -2)).withColumn(
        "filename", F.element_at(F.split("path", "/"), -1)
    )


def _open(content: bytes):
    reader = wave.open(io.BytesIO(content))
    return reader, reader.getparams()


def audio_properties(files: DataFrame) -> DataFrame:
    """Header scan: (filename, label, duration_s, sample_rate_hz, channels, bit_depth_bits,
    file_size_bytes). Unreadable files are dropped; durations have millisecond resolution."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                try:
                    _, p = _open(row.content)
                except (wave.Error, EOFError, struct.error):
                    continue
                rows.append(
                    (row.filename, row.label, int(p.nframes * 1000 / p.framerate) / 1000.0,
                     p.framerate, p.nchannels, p.sampwidth * 8, row.length)
                )
            yield pd.DataFrame(
                rows,
                columns=["filename", "label", "duration_s", "sample_rate_hz", "channels", "bit_depth_bits", "file_size_bytes"],
            )

    return files.select("filename", "label", "length", "content").mapInPandas(
        run,
        "filename string, label string, duration_s double, sample_rate_hz int, channels int, "
        "bit_depth_bits int, file_size_bytes long",
    )


def pcm_to_float(raw: bytes, width: int) -> np.ndarray:
    """Integer PCM of 1..4 bytes to floats in [-1, 1)."""
    if width == 1:
        return (np.frombuffer(raw, dtype=np.uint8).astype(np.float64) - 128.0) / 128.0
    if width == 3:
        packed = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3)
        shifted = np.zeros((len(packed), 4), dtype=np.uint8)
        shifted[:, 1:] = packed
        return shifted.view("<i4").ravel() / 2.0**31
    return np.frombuffer(raw, dtype=f"<i{width}") / 2.0 ** (8 * width - 1)


def decode_audio(files: DataFrame, block: int = SAMPLES_PER_BLOCK) -> DataFrame:
    """Samples in bounded blocks: (signal_id, label, sr, channels, n, channel, start, y).

    Frames are read block by block, so a long recording never becomes one row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                try:
                    reader, p = _open(row.content)
                except (wave.Error, EOFError, struct.error):
                    continue
                for start in range(0, p.nframes, block):
                    frames = pcm_to_float(reader.readframes(block), p.sampwidth)
                    frames = frames.reshape(-1, p.nchannels)
                    yield pd.DataFrame(
                        {
                            "signal_id": row.signal_id,
                            "label": row.label,
                            "sr": p.framerate,
                            "channels": p.nchannels,
                            "n": p.nframes,
                            "channel": np.arange(p.nchannels),
                            "start": start,
                            "y": [np.ascontiguousarray(frames[:, c]) for c in range(p.nchannels)],
                        }
                    )

    named = files.select(
        F.concat_ws("_", "label", F.regexp_replace("filename", r"\.wav$", "")).alias("signal_id"),
        "label",
        "content",
    )
    return named.mapInPandas(
        run,
        "signal_id string, label string, sr int, channels int, n long, channel int, start long, "
        "y array<double>",
    )


def audio_signal(blocks: DataFrame) -> DataFrame:
    """Mono samples in long form: (signal_id, i, n, y), channels averaged block by block."""
    rows = blocks.select(
        "signal_id", "n", "channels", "channel", "start", F.posexplode("y").alias("k", "y")
    ).withColumn("i", F.col("start") + F.col("k"))
    single = rows.filter("channels = 1").select("signal_id", "i", "n", "y")
    mixed = (
        rows.filter("channels > 1")
        .groupBy("signal_id", "i")
        .agg(F.first("n").alias("n"), F.avg("y").alias("y"))
        .select("signal_id", "i", "n", "y")
    )
    return single.unionByName(mixed)


def wav_bytes(y: np.ndarray, rate: int) -> bytes:
    """16-bit mono file content."""
    code = np.clip(np.rint(np.asarray(y) * 32767.0), -32768, 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as writer:
        writer.setnchannels(1)
        writer.setsampwidth(2)
        writer.setframerate(rate)
        writer.writeframes(code.tobytes())
    return out.getvalue()


def write_audio(segments: DataFrame, folder: str, rate: int = 25000) -> DataFrame:
    """Write fixed-length segments (signal_id, label, y array) as files of a shared folder, which may be a URI.

    A retried task leaves one whole file. Returns the (signal_id, path) written; the files appear when an action runs.
    """

    def run(batches):
        for pdf in batches:
            paths = []
            for row in pdf.itertuples(index=False):
                target = f"{folder.rstrip('/')}/{row.label}/{row.signal_id}.wav"
                with whole_file(target) as out:
                    out.write(wav_bytes(row.y, rate))
                paths.append(target)
            yield pd.DataFrame({"signal_id": pdf["signal_id"].astype(str), "path": paths})

    return segments.select("signal_id", "label", "y").mapInPandas(run, "signal_id string, path string")


def segment_arrays(segments: DataFrame) -> DataFrame:
    """Segments of bounded length back to one array per signal."""
    return segments.groupBy("signal_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "y")))["y"].alias("y")
    )
