"""From audio files to analysis segments and recurrence images: decoding, mono mix, resampling, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import recurrence, segment
from ..session import stage
from ..sources.audio import decode_audio

RATE = 25000


def audio_series(files: DataFrame, rate: int = RATE) -> DataFrame:
    """Mono samples (signal_id, i, n, y) at one rate of files (label, filename, content).

    Files are decoded in blocks and stay in long form, so a long recording spreads over many tasks.
    """
    samples = decode_audio(files).select("signal_id", "sr", "n", "start", F.posexplode("y").alias("k", "y"))
    mono = samples.groupBy("signal_id", "sr", "n", (F.col("start") + F.col("k")).cast("long").alias("i")).agg(
        F.avg("y").alias("y")
    )
    return segment.resample(stage(mono), rate)


def audio_segments(files: DataFrame, rate: int = RATE, **options) -> DataFrame:
    """Peak-normalised segments of equal length, chosen around each file's longest activity."""
    return segment.preprocess(stage(audio_series(files, rate)), **options)


def audio_images(files: DataFrame, m: int = 7, tau: int = 9, rate: int = RATE, halo: int = 0, **options) -> DataFrame:
    """Grayscale recurrence images of the segments, as tiles."""
    return recurrence.recurrence_tiles(stage(audio_segments(files, rate, **options)), m, tau, halo=halo)
