"""From raw documents to packed training sequences, in stages that each use one operator of recurra.llm.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents. Rows without doc_id are kept by every filter that needs an id to decide.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.llm import decontam, neardup, packing, quality, secrets
from recurra.session import stage, work_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.keep_good(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; repeated rows of it once."""
    found = neardup.near_duplicates(docs.select("doc_id", "text"), size=5, percent=80)
    gone = stage(found.filter("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null")
    again = stage(again.select(F.col("doc_id").alias("_again")))
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    if again.isEmpty():
        return kept
    single = kept.join(again, kept["doc_id"] == again["_again"], "left_anti")
    repeated = kept.join(again, kept["doc_id"] == again["_again"], "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(repeated)


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontam.decontaminate(decontam.row_key(docs).select("key", "text"), items)
    hit = stage(found.select(F.col("key").alias("_key")))
    return docs.join(hit, F.xxhash64(docs["doc_id"], docs["text"]) == hit["_key"], "left_anti")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars counted anew."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces with a place in a sequence."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_texts),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack),
]

# Learned scores decide in the first stage, so no SQL statement gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again before the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{work_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, apply) in enumerate(STAGES):
        path = f"{folder}/{k}"
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
