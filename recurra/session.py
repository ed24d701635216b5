"""Session helpers: sensible defaults for tests, and reliable lineage cuts for clusters."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "recurra", cores: int | None = None, **conf) -> SparkSession:
    """Local session for tests and benches; on a cluster the caller brings its own."""
    cores = cores or os.cpu_count()
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only on a local master that names none (tests)."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="recurra-work-")
        context.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate result that several branches read, and read it back.

    A written table survives lost executors, keeps column pruning and is computed once.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
