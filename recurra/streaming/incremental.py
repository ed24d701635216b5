"""Incremental feature extraction: new signal files in, missing features appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.framework import missing_work
from ..operators.recurrence import recurrence_tiles
from ..plans.descriptors import get_descriptor, halo_needed
from ..session import stage
from ..sources.results import read_features, write_features
from ..sources.tables import signal_from_arrays


def extract_missing(
    signals: DataFrame, store: str, names, m: int = 7, tau: int = 9, configs: dict | None = None
) -> None:
    """Compute and append the features of (signal_id, y array) rows that the store lacks.

    The recurrence images of the batch are written once and read by every descriptor.
    """
    configs = configs or {}
    spark = signals.sparkSession
    todo = {}
    for name in names:
        d = get_descriptor(name)
        settings = {**d.config, **configs.get(name, {})}
        digest = d.hash({**settings, "m": m, "tau": tau})
        done = read_features(spark, store, name, digest)
        ids = signals.select(F.col("signal_id").alias("image_id")).distinct()
        todo[name] = (d, settings, digest, ids if done is None else missing_work(ids, done, ["image_id"]))
    needed = None
    for _, _, _, ids in todo.values():
        needed = ids if needed is None else needed.union(ids)
    needed = stage(needed.distinct())
    if needed.isEmpty():
        return
    batch = signals.join(needed.withColumnRenamed("image_id", "signal_id"), "signal_id", "left_semi")
    tiles = stage(
        recurrence_tiles(signal_from_arrays(batch, "signal_id", "y"), m, tau, halo=halo_needed(names))
    )
    for d, settings, digest, ids in todo.values():
        rows = tiles.join(ids, "image_id", "left_semi")
        write_features(d.build(rows, **settings), store, d.name, digest)


def stream_features(
    spark: SparkSession,
    source: str,
    store: str,
    checkpoint: str,
    names=("glcm", "lbp"),
    m: int = 7,
    tau: int = 9,
    schema: str = "signal_id string, y array<double>",
) -> StreamingQuery:
    """Process the signal files that arrived since the last run, then stop.

    A batch replayed after a failure finds its results in the store and adds nothing.
    """
    arrivals = spark.readStream.schema(schema).parquet(source)

    def handle(batch: DataFrame, _: int) -> None:
        extract_missing(batch.dropDuplicates(["signal_id"]), store, names, m, tau)

    return (
        arrivals.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
