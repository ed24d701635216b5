"""Feature tables, manifests and reports on storage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.framework import combine


def write_features(features: DataFrame, folder: str, descriptor: str, digest: str) -> None:
    """Append features under descriptor=/config_hash=; a rerun adds only what the caller passes."""
    (
        features.withColumn("computed_at", F.current_timestamp())
        .write.mode("append")
        .parquet(f"{folder}/descriptor={descriptor}/config_hash={digest}")
    )


def read_features(spark: SparkSession, folder: str, descriptor: str, digest: str) -> DataFrame | None:
    """Stored features of one descriptor and configuration, or None if nothing is stored there.

    Only a missing path counts as nothing; any other failure to read is raised.
    """
    try:
        return spark.read.parquet(f"{folder}/descriptor={descriptor}/config_hash={digest}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored_descriptors(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(descriptor, configuration hash) of everything stored in a folder."""
    found = []
    path, files = _files(spark, folder)
    for outer in files.listStatus(path) if files.exists(path) else ():
        kind = outer.getPath().getName()
        if kind.startswith("descriptor="):
            for inner in files.listStatus(outer.getPath()):
                name = inner.getPath().getName()
                if name.startswith("config_hash="):
                    found.append((kind.removeprefix("descriptor="), name.removeprefix("config_hash=")))
    return sorted(found)


def drop_stored(spark: SparkSession, folder: str, descriptor: str, digest: str | None = None) -> bool:
    """Remove the stored features of a descriptor, of one configuration or of all; False if there were none."""
    name = f"{folder}/descriptor={descriptor}" + (f"/config_hash={digest}" if digest else "")
    path, files = _files(spark, name)
    return files.exists(path) and files.delete(path, True)


def combine_stored(spark: SparkSession, folder: str, hashes: dict[str, str], key: str = "image_id") -> DataFrame:
    """Inner join of stored descriptors {name: hash}."""
    tables = [read_features(spark, folder, name, digest).drop("computed_at") for name, digest in hashes.items()]
    return combine(tables, key)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, numeric_from: int = 2) -> DataFrame:
    """Feature CSV with a header: the first columns are text, the others doubles."""
    names = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(
        f"`{n}` {'string' if k < numeric_from else 'double'}" for k, n in enumerate(names)
    )
    return spark.read.option("header", True).schema(schema).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def latest_file(files: DataFrame) -> DataFrame:
    """Newest file of a ``binaryFile`` listing: (path, modificationTime)."""
    return files.agg(F.max(F.struct("modificationTime", "path")).alias("m")).select("m.path", "m.modificationTime")


def selection_document(ranked: DataFrame, summary: DataFrame) -> DataFrame:
    """One nested row: dataset summary and the selected features in rank order."""
    chosen = ranked.agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in ranked.columns if c != "rank"]))))
    classes = summary.agg(F.collect_list(F.struct(*summary.columns)))
    one = ranked.sparkSession.range(1)
    return one.select(
        F.current_timestamp().alias("created_at"),
        classes.scalar().alias("data_summary"),
        chosen.scalar().alias("selected_features"),
    )


def _markdown(df: DataFrame, order: str | None = None, most: int = 2000) -> list[str]:
    """Lines of a table; more rows than a reader could want are an error, not a cut."""
    rows = (df.orderBy(order) if order else df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report shows at most {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return lines + ["| " + " | ".join(str(v) for v in row) + " |" for row in rows]


def selection_report(ranked: DataFrame, summary: DataFrame | None = None, settings: dict | None = None, **sections: DataFrame) -> str:
    """Markdown: settings, data summary, selected features in rank order and any further titled tables.

    Without further arguments it is the table of the selected features alone.
    """
    table = _markdown(ranked, "rank")
    if summary is None and settings is None and not sections:
        return "\n".join(table)
    lines = ["# Feature selection"]
    if settings:
        lines += ["", "## Settings", "", *[f"* {name}: {value}" for name, value in sorted(settings.items())]]
    if summary is not None:
        lines += ["", "## Data", "", *_markdown(summary)]
    lines += ["", "## Selected features", "", *table]
    for title, df in sections.items():
        lines += ["", f"## {title.replace('_', ' ').capitalize()}", "", *_markdown(df)]
    return "\n".join(lines) + "\n"


RECORD = (
    "subset string, model_name string, n_train long, n_test long, accuracy double, precision double, recall double, "
    "f1_score double, roc_auc double, cv_f1_mean double, cv_f1_std double, train_time double, predict_time double"
)


def classification_document(spark: SparkSession, records: list[dict]) -> DataFrame:
    """One row per subset: its models with all their scores, and the best of them. ``records`` is what classify returns."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    rows = spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], RECORD)
    models = F.struct(*[n for n in names if n != "subset"])
    # of equal scores the name that sorts first wins, as in best_results
    best = F.min(F.struct(-F.col("f1_score"), "model_name"))["model_name"]
    return rows.groupBy("subset").agg(
        F.array_sort(F.collect_list(models), lambda a, b: F.when(a["model_name"] < b["model_name"], -1).when(a["model_name"] > b["model_name"], 1).otherwise(0)).alias("models"),
        best.alias("best_model"),
    )


def write_classification(spark: SparkSession, records: list[dict], path: str) -> None:
    """The document as JSON lines."""
    write_json(classification_document(spark, records), path)


def read_classification(spark: SparkSession, path: str) -> DataFrame:
    """Records of a written document again, one row per subset and model, with ``is_best``."""
    fields = ", ".join(f"{c.split()[0]}: {c.split()[1].replace('long', 'bigint')}" for c in RECORD.split(", ")[1:])
    document = spark.read.schema(f"subset string, models array<struct<{fields}>>, best_model string").json(path)
    each = document.select("subset", "best_model", F.explode("models").alias("m"))
    return each.select("subset", "m.*", (F.col("m.model_name") == F.col("best_model")).alias("is_best"))
