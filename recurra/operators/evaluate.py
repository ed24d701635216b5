"""Classification metrics from (row_id, label, prediction, score) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safe_div
from ..session import stage
from .chunks import range_chunks, running_totals


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("c"))


def row_normalized(table: DataFrame) -> DataFrame:
    """Confusion counts as shares of the true class."""
    total = F.sum("c").over(Window.partitionBy("label"))
    return table.withColumn("share", F.col("c") / total)


def class_scores(table: DataFrame) -> DataFrame:
    """Precision, recall and F1 per true class; zero where undefined: (label, support, ...)."""
    hits = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("c")).otherwise(0))
    support = table.groupBy("label").agg(F.sum("c").alias("support"), hits.alias("tp"))
    called = table.groupBy(F.col("prediction").alias("label")).agg(F.sum("c").alias("called"))
    return support.join(called, "label", "left").select(
        "label",
        "support",
        "tp",
        F.coalesce(safe_div(F.col("tp"), F.col("called")), F.lit(0.0)).alias("precision"),
        (F.col("tp") / F.col("support")).alias("recall"),
        (2 * F.col("tp") / (F.col("support") + F.coalesce("called", F.lit(0)))).alias("f1_score"),
    )


def weighted_scores(table: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1: one row."""
    weight, total = F.col("support"), F.sum("support")
    return class_scores(table).agg(
        (F.sum("tp") / total).alias("accuracy"),
        *[
            (F.sum(F.col(m) * weight) / total).alias(m) for m in ("precision", "recall", "f1_score")
        ],
    )


def weighted_f1_by(predictions: DataFrame, group: str) -> DataFrame:
    """Support-weighted F1 of every group of predictions (group, label, prediction): (group, f1_score)."""
    counts = predictions.groupBy(group, "label", "prediction").agg(F.count(F.lit(1)).alias("c"))
    sides = counts.select(
        group,
        F.explode(F.array(
            F.struct(F.col("label").alias("kind"), F.col("c").alias("s"), F.when(F.col("label") == F.col("prediction"), F.col("c")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("called")),
            F.struct(F.col("prediction").alias("kind"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("tp"), F.col("c").alias("called")),
        )).alias("p"),
    ).groupBy(group, "p.kind").agg(*[F.sum(f"p.{c}").alias(c) for c in ("s", "tp", "called")])
    own = F.col("s") * 2 * F.col("tp") / (F.col("s") + F.col("called"))
    return sides.groupBy(group).agg((F.sum(own) / F.sum("s")).alias("f1_score"))


def _by_score(predictions: DataFrame, positive) -> DataFrame:
    """Distinct scores in descending order with running positives and negatives."""
    hit = F.col("label") == positive
    counts = (
        predictions.filter(F.col("score").isNotNull())
        .groupBy("score")
        .agg(F.sum(hit.cast("long")).alias("pos"), F.sum((~hit).cast("long")).alias("neg"))
    )
    ranged = range_chunks(counts.withColumn("all", F.lit(1)), ["all"], [F.desc("score")])
    swept = running_totals(ranged, ["all"], [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, F.col("_range"))
    return swept.drop("all", "_range")


def roc_points(predictions: DataFrame, positive) -> DataFrame:
    """(score, tpr, fpr) at every distinct threshold, highest first."""
    swept = stage(_by_score(predictions, positive))
    pos, neg = swept.agg(F.sum("pos")).scalar(), swept.agg(F.sum("neg")).scalar()
    return swept.select("score", (F.col("tp") / pos).alias("tpr"), (F.col("fp") / neg).alias("fpr"))


def roc_auc(predictions: DataFrame, positive) -> DataFrame:
    """Rank-sum area with ties counted half; NULL if a class is missing: one row (roc_auc)."""
    swept = _by_score(predictions, positive)
    # positives ranked strictly above a negative count 1, those tied with it 1/2
    won = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    return swept.agg(safe_div(F.sum(won), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def best_by_group(results: DataFrame, group: str, order: str = "position", metric: str = "f1_score") -> DataFrame:
    """Best row per group; the earliest wins ties."""
    w = Window.partitionBy(group).orderBy(F.desc(metric), order)
    return results.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def comparison(results: DataFrame, metric: str = "f1_score") -> DataFrame:
    return results.orderBy(F.desc(metric))
