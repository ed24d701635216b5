"""Feature selection in one call: significance, effect size, ranking, redundancy, separability."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import selection
from ..session import stage
from ..sources.results import selection_document

MOST_FEATURES = 2000  # the redundancy and separability phases work on all pairs of columns


@dataclass(frozen=True)
class SelectionConfig:
    alpha: float = 0.05
    min_effect: float = 0.2
    f_weight: float = 0.7
    mi_weight: float = 0.3
    max_correlation: float = 0.85
    target: int = 15
    components: int = 10


@dataclass(frozen=True)
class Selection:
    """Tables of the five phases; `document` nests them in one row."""

    rejected_by_p: DataFrame
    rejected_by_effect: DataFrame
    ranked: DataFrame
    rejected_by_redundancy: DataFrame
    selected: DataFrame
    validation: DataFrame
    document: DataFrame


def select_features(long: DataFrame, config: SelectionConfig = SelectionConfig()) -> Selection:
    """Run all phases on features(row_id, label, feature, value) of two classes.

    A feature is rejected by the first phase it fails, and is listed there with its statistics. Tables of
    statistics have a row per feature; the number of features is bounded and checked.
    """
    stats = stage(selection.class_stats(long))
    scores = stage(selection.anova(stats).join(selection.cohens_d(stats), "feature"))
    count = scores.count()
    if count > MOST_FEATURES:
        raise ValueError(f"{count} features; at most {MOST_FEATURES} can be compared pair by pair")
    significant = selection.significant(scores, config.alpha)
    practical = stage(significant.filter(F.abs("cohens_d") >= config.min_effect))
    weak = significant.filter(F.abs("cohens_d") < config.min_effect)

    kept = long.join(practical.select("feature"), "feature", "left_semi")
    informed = stage(practical.join(selection.knn_information(kept), "feature"))
    ranked = stage(selection.combined_ranking(informed, config.f_weight, config.mi_weight))
    names = [row.feature for row in ranked.select("feature").orderBy("feature").collect()]
    if not names:
        nothing = ranked.select("rank", "feature").limit(0)
        none = nothing.withColumns({"correlated_with": F.lit(None).cast("string"), "max_correlation": F.lit(None).cast("double")})
        document = selection_document(nothing, selection.dataset_summary(long))
        return Selection(selection.rejected(scores, config.alpha), weak, ranked, none, ranked, nothing.limit(0), document)

    vectors = stage(selection.as_vectors(selection.z_scores(kept)))
    name = F.array(*[F.lit(n) for n in names])
    pairs = stage(selection.correlation_matrix(vectors).select(
        F.get(name, F.col("a")).alias("a"), F.get(name, F.col("b")).alias("b"), "r"
    ))
    passed = stage(selection.drop_redundant(ranked.select("rank", "feature"), pairs, config.target, config.max_correlation))
    chosen = passed.filter("kept").select(F.col("feature").alias("_f"))
    order = ranked.withColumn("_f", F.col("feature").cast("string")).join(chosen, "_f", "left_semi").drop("_f")
    told = selection.justification(F.col("p_value"), F.col("cohens_d"), F.col("f_score"))
    selected = stage(order.withColumn("descriptor", selection.family(F.col("feature").cast("string"))).withColumn("justification", told))

    final = stage(selection.as_vectors(selection.z_scores(kept.join(selected.select("feature"), "feature", "left_semi"))))
    total = selection.explained_variance(selection.correlation_matrix(final), config.components).agg(F.max("total")).first()[0]
    silhouette = selection.silhouette(final).first()
    validation = selection.fisher_ratio(final).select(
        selection.separability(F.lit(total), F.lit(silhouette.silhouette_score), F.col("fisher_ratio")).alias("criteria"),
        F.lit(silhouette.silhouette_interpretation).alias("silhouette_interpretation"),
        "inter_class_distance", "intra_class_distance",
    )
    redundant = passed.filter("NOT kept").select("rank", "feature", "correlated_with", "max_correlation")
    document = selection_document(selected, selection.dataset_summary(long)).withColumn(
        "validation", validation.select(F.struct("*").alias("v")).scalar()
    ).withColumn("configuration", F.struct(*[F.lit(v).alias(k) for k, v in asdict(config).items()]))
    return Selection(selection.rejected(scores, config.alpha), weak, ranked, redundant, selected, validation, document)
