"""Feature selection: significance, effect size, information, redundancy, separability.

Features come long, (row_id, label, feature, value), or as vectors, (row_id, label, x).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import digamma, f_survival, safe_div
from ..session import stage
from .blocks import map_rows
from .chunks import chunk_with_halo, ordered_index, range_chunks, running_totals
from .grid import ROWS, block_grid, strips
from .inversions import sign_products

NEAR = 1e-6  # share of the largest squares up to which the square of a distance is not left to a matrix product
VALUE_CHUNKS = 4096


def as_vectors(long: DataFrame) -> DataFrame:
    """(row_id, label, x) with the values in feature order."""
    return (
        long.groupBy("row_id", "label")
        .agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("_s"))
        .select("row_id", "label", F.col("_s.value").alias("x"))
    )


def class_stats(long: DataFrame) -> DataFrame:
    """n, mean and sample variance per feature and class: the only shuffle of the first two phases."""
    return (
        long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("feature", "label")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var"),
        )
    )


def anova(stats: DataFrame) -> DataFrame:
    """One-way F statistic with its p-value; both NULL for a constant feature."""
    by_feature = Window.partitionBy("feature")
    grand = F.sum(F.col("n") * F.col("mean")).over(by_feature) / F.sum("n").over(by_feature)
    sums = (
        stats.withColumn("gap", F.col("mean") - grand)
        .groupBy("feature")
        .agg(
            F.sum(F.col("n") * F.col("gap") * F.col("gap")).alias("between"),
            F.sum((F.col("n") - 1) * F.col("var")).alias("within"),
            (F.count("label") - 1).cast("double").alias("d1"),
            (F.sum("n") - F.count("label")).cast("double").alias("d2"),
        )
    )
    score = safe_div(F.col("between") / F.col("d1"), F.col("within") / F.col("d2"))
    return sums.withColumn("f_score", score).select(
        "feature", "f_score", f_survival("f_score", "d1", "d2").alias("p_value")
    )


def significant(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    return scores.filter(F.col("p_value") < alpha)


def rejected(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Features that are not significant, the nearest to it first; constant ones, without p-value, last.

    One row per feature, so a single ordering is bounded by the number of columns.
    """
    place = F.row_number().over(Window.orderBy(F.col("p_value").asc_nulls_last(), "feature"))
    return scores.filter(F.col("p_value").isNull() | F.isnan("p_value") | (F.col("p_value") >= alpha)).withColumn("place", place)


def effect_label(d):
    size = F.abs(d)
    return (
        F.when(size < 0.2, "trivial").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")
    )


def cohens_d(stats: DataFrame, first=None) -> DataFrame:
    """Pooled-deviation effect size of two classes: (feature, cohens_d, effect_size).

    ``first`` names the class whose mean comes first in the difference; else the smaller label.
    """
    is_first = F.col("label") == (F.lit(first) if first is not None else F.min("label").over(Window.partitionBy("feature")))
    tagged = stats.withColumn("_first", is_first)

    def pick(col, flag):
        return F.max(F.when(F.col("_first") == flag, F.col(col)))

    n0, n1 = pick("n", True), pick("n", False)
    pooled = F.sqrt(((n0 - 1) * pick("var", True) + (n1 - 1) * pick("var", False)) / (n0 + n1 - 2))
    d = (
        F.when(F.count("label") != 2, F.raise_error(F.lit("effect size needs exactly two classes")))
        .when(pooled > 0, (pick("mean", True) - pick("mean", False)) / pooled)
        .otherwise(F.lit(0.0))
    )
    return (
        tagged.groupBy("feature")
        .agg(d.cast("double").alias("cohens_d"))
        .withColumn("effect_size", effect_label(F.col("cohens_d")))
    )


def effect_distribution(effects: DataFrame) -> DataFrame:
    return effects.groupBy("effect_size").agg(F.count(F.lit(1)).alias("c"))


def knn_information(long: DataFrame, k: int = 3) -> DataFrame:
    """Nearest-neighbour mutual information of each feature with the class: (feature, mi_score).

    Distinct values carry counts, so ties collapse before anything is ordered. The radius of a
    value is the distance to its k-th neighbour in the same class; the points of all classes
    closer than that are counted with running totals over value chunks. Points at the radius (to a
    relative 1e-9, so rounding cannot decide) are outside. No random jitter is added.
    """
    counts = long.groupBy("feature", "label", "value").agg(F.count(F.lit(1)).alias("c"))
    classes = counts.groupBy("feature", "label").agg(F.sum("c").alias("nc")).filter("nc > 1")
    points = range_chunks(counts.join(classes, ["feature", "label"]), ["feature", "label"], ["value"])
    keyed = points.withColumn("g", F.struct("feature", "label"))
    ranked = ordered_index(keyed, "g", ["value"], F.col("_range")).drop("n")
    near = chunk_with_halo(ranked, "i", VALUE_CHUNKS, k, k)
    w = Window.partitionBy("g", "b").orderBy("i")
    sides = [
        F.struct(F.abs(F.col("value") - move("value", s).over(w)).alias("d"), move("c", s).over(w).alias("m"))
        for s in range(1, k + 1)
        for move in (F.lag, F.lead)
    ]
    around = F.array(F.struct(F.lit(0.0).alias("d"), (F.col("c") - 1).alias("m")), *sides)
    reach = F.least(F.lit(k), F.col("nc") - 1)
    radius = F.expr(
        "aggregate(array_sort(filter(around, s -> s.d IS NOT NULL)), "
        "named_struct('left', reach, 'r', 0D), "
        "(a, s) -> if(a.left <= 0, a, named_struct('left', a.left - s.m, 'r', s.d)), a -> a.r * (1 - 1e-9D))"
    )
    measured = (
        near.withColumn("around", around)
        .filter("own")
        .withColumn("reach", reach)
        .withColumn("r", radius)
        .select("feature", "label", "value", "c", "nc", "reach", "r")
    )
    measured = stage(measured)
    # Queries: points strictly below value + r, minus points at or below value - r (r = 0: equal values).
    marks = F.array(
        F.struct((F.col("value") + F.col("r")).alias("at"), F.when(F.col("r") > 0, 0).otherwise(2).alias("turn"), F.lit(1).alias("sign")),
        F.struct((F.col("value") - F.col("r")).alias("at"), F.when(F.col("r") > 0, 2).otherwise(0).alias("turn"), F.lit(-1).alias("sign")),
    )
    queries = measured.withColumn("q", F.explode(marks)).select(
        "feature", "label", "value", "q.at", "q.turn", "q.sign", F.lit(0).cast("long").alias("add")
    )
    sites = points.groupBy("feature", "value").agg(F.sum("c").alias("add")).select(
        "feature",
        F.lit(None).cast(long.schema["label"].dataType).alias("label"),
        F.lit(None).cast("double").alias("value"),
        F.col("value").alias("at"),
        F.lit(1).alias("turn"),
        F.lit(0).alias("sign"),
        "add",
    )
    marked = range_chunks(queries.unionByName(sites), ["feature"], ["at", "turn"])
    swept = running_totals(marked, ["feature"], ["at", "turn"], {"seen": F.col("add")}, F.col("_range"))
    inside = (
        swept.filter("sign <> 0")
        .groupBy("feature", "label", "value")
        .agg(F.sum(F.col("sign") * F.col("seen")).alias("m"))
    )
    c = F.col("c")
    total = F.sum("c")
    score = (
        digamma(total)
        + F.sum(c * digamma(F.col("reach"))) / total
        - F.sum(c * digamma(F.col("nc"))) / total
        - F.sum(c * digamma(F.col("m"))) / total
    )
    return (
        measured.join(inside, ["feature", "label", "value"])
        .groupBy("feature")
        .agg(F.greatest(score, F.lit(0.0)).alias("mi_score"))
    )


def binned_information(long: DataFrame, bins: int = 10) -> DataFrame:
    """Mutual information in nats between equal-width value bins and the class."""
    slot = F.least(
        F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)
    )
    spans = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    cells = (
        long.join(spans, "feature")
        .withColumn("bin", F.when(F.col("hi") > F.col("lo"), slot).otherwise(0))
        .groupBy("feature", "bin", "label")
        .agg(F.count(F.lit(1)).cast("double").alias("c"))
    )
    n = F.sum("c").over(Window.partitionBy("feature"))
    by_bin = F.sum("c").over(Window.partitionBy("feature", "bin"))
    by_label = F.sum("c").over(Window.partitionBy("feature", "label"))
    return (
        cells.withColumn("t", F.col("c") / n * F.log(F.col("c") * n / (by_bin * by_label)))
        .groupBy("feature")
        .agg(F.sum("t").alias("mi_score"))
    )


def min_max(table: DataFrame, columns: list[str]) -> DataFrame:
    """Scale to [0, 1] over the rows given (one per feature); a constant column becomes 0."""
    for name in columns:
        low = table.agg(F.min(name)).scalar()
        high = table.agg(F.max(name)).scalar()
        table = table.withColumn(
            f"{name}_norm",
            F.when(high > low, (F.col(name) - low) / (high - low)).otherwise(F.lit(0.0)),
        )
    return table


def combined_ranking(scores: DataFrame, f_weight: float = 0.7, mi_weight: float = 0.3) -> DataFrame:
    """Rank features by the weighted sum of the scaled scores (name breaks ties).

    One row per feature, so a single ordering is bounded by the number of columns.
    """
    scaled = min_max(scores, ["f_score", "mi_score"]).withColumn(
        "combined_score", f_weight * F.col("f_score_norm") + mi_weight * F.col("mi_score_norm")
    )
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("combined_score"), "feature")
    return scaled.withColumn("rank", F.row_number().over(order))


def average_ranks(long: DataFrame) -> DataFrame:
    """Replace values by their average rank within the feature (ties share it)."""
    counts = range_chunks(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c")), ["feature"], ["value"])
    ranked = running_totals(counts, ["feature"], ["value"], {"upto": F.col("c")}, F.col("_range")).select("feature", "value", (F.col("upto") - (F.col("c") - 1) / 2).alias("rank"))
    return long.join(ranked, ["feature", "value"]).select(
        "row_id", "label", "feature", F.col("rank").alias("value")
    )


def correlation_matrix(vectors: DataFrame, method: str = "pearson") -> DataFrame:
    """All feature pairs: (a, b, r), r NULL for a constant feature.

    Pearson: every task adds up its centred cross products. Kendall: inversions, counted by sorting
    inside chunks and by numbers of rows between them. For Spearman pass vectors of ``average_ranks`` to Pearson.
    """
    if method == "kendall":
        products = sign_products(vectors)
    elif method == "pearson":
        products = _cross_products(vectors)
    else:
        raise ValueError("rank the values first for spearman; other methods: pearson, kendall")
    sums = products.groupBy("a", "b").agg(F.sum("s").alias("s"))
    diag = sums.filter("a = b").select(F.col("a").alias("k"), F.col("s").alias("v"))
    left, right = diag.toDF("a", "va"), diag.toDF("b", "vb")
    return (
        sums.join(left, "a")
        .join(right, "b")
        .select("a", "b", safe_div(F.col("s"), F.sqrt(F.col("va") * F.col("vb"))).alias("r"))
    )


def _cross_products(vectors: DataFrame) -> DataFrame:
    means = vectors.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"))
    centre = means.agg(F.array_sort(F.collect_list(F.struct("k", "m")))["m"]).scalar()

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy()) - np.asarray(pdf["mu"].iloc[0])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            a, b = np.indices(total.shape)
            yield pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "s": total.ravel()})

    return vectors.select("x", centre.alias("mu")).mapInPandas(run, "a int, b int, s double")


def drop_redundant(
    ranked: DataFrame, pairs: DataFrame, limit: int = 15, threshold: float = 0.85
) -> DataFrame:
    """Greedy pass in rank order: (rank, feature, kept, correlated_with, max_correlation).

    ``ranked`` is (rank, feature) and ``pairs`` (a, b, r), both bounded by the number of columns;
    the pass is a fold over one sorted array. Features after the limit is reached are left out.
    """
    names = ranked.agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("feature").cast("string").alias("f"))))["f"]
    ).scalar()
    table = pairs.agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat_ws("|", "a", "b"), F.coalesce(F.abs("r"), F.lit(0.0))))
        )
    ).scalar()
    blank = "CAST(array() AS array<struct<f:string,kept:boolean,other:string,r:double>>)"
    best = (
        "array_max(transform(filter(acc, s -> s.kept), (s, i) -> "
        "named_struct('r', m[concat(x, '|', s.f)], 'at', -i, 'f', s.f)))"
    )
    step = (
        f"if(size(filter(acc, s -> s.kept)) >= {limit}, acc, concat(acc, transform(array({best}), t -> "
        f"named_struct('f', x, 'kept', t.r IS NULL OR t.r < {threshold!r}D, "
        f"'other', if(t.r < {threshold!r}D, NULL, t.f), 'r', t.r))))"
    )
    one = ranked.sparkSession.range(1).select(names.alias("names"), table.alias("m"))
    return one.selectExpr(f"posexplode(aggregate(names, {blank}, (acc, x) -> {step})) AS (pos, s)").selectExpr(
        "pos + 1 AS rank", "s.f AS feature", "s.kept AS kept", "s.other AS correlated_with", "s.r AS max_correlation"
    )


def z_scores(long: DataFrame) -> DataFrame:
    """Standardise with the population deviation; a constant feature is only centred."""
    stats = long.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    scaled = (F.col("value") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    return long.join(stats, "feature").select("row_id", "label", "feature", scaled.alias("value"))


def explained_variance(pairs: DataFrame, components: int = 10) -> DataFrame:
    """Share of variance of the leading components of standardised data: (component, share, total).

    Works on the correlation matrix, whose size is the number of columns squared.
    """
    matrix = pairs.agg(F.array_sort(F.collect_list(F.struct("a", "b", "r"))).alias("cells"))

    def run(batches):
        for pdf in batches:
            for cells in pdf["cells"]:
                size = int(round(len(cells) ** 0.5))
                r = np.array([0.0 if c["r"] is None else c["r"] for c in cells]).reshape(size, size)
                roots = np.sort(np.linalg.eigvalsh(r))[::-1][:components] / np.trace(r)
                yield pd.DataFrame(
                    {"component": np.arange(1, len(roots) + 1), "share": roots, "total": roots.cumsum()}
                )

    return matrix.mapInPandas(run, "component int, share double, total double")


def pair_by_pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    square = np.zeros((len(left), len(right)))
    for k in range(left.shape[1]):
        square += (left[:, k][:, None] - right[:, k][None, :]) ** 2
    return square


def distances(left: np.ndarray, right: np.ndarray):
    """(slice, distances) of strips of the left rows to all right rows.

    Squares come from one matrix product of centred rows; pairs so near that it would round them away are taken again.
    """
    centre = right.mean(axis=0)
    p, q = left - centre, right - centre
    p_square, q_square = (p * p).sum(axis=1), (q * q).sum(axis=1)
    sound = np.isfinite(p_square).all() and np.isfinite(q_square).all()
    turned = -2 * q.T
    for part in strips(len(left)):
        near = None
        if sound:
            square = p[part] @ turned
            square += p_square[part, None]
            square += q_square
            near = np.flatnonzero(square <= NEAR * (p_square[part, None].max(initial=0) + q_square.max(initial=0)))
        if near is None or len(near) > square.size // 16:
            square = pair_by_pair(left[part], right)
        else:
            i, j = np.divmod(near, len(right))
            apart = left[part][i] - right[j]
            square[i, j] = (apart * apart).sum(axis=1)
        yield part, np.sqrt(square, out=square)


def silhouette_rows(vectors: DataFrame, size: int = ROWS) -> DataFrame:
    """Exact Euclidean silhouette per row: (row_id, label, a, b, s)."""
    label_type = vectors.schema["label"].dataType
    out = T.StructType(
        [
            T.StructField("row_id", vectors.schema["row_id"].dataType),
            T.StructField("label", label_type),
            T.StructField("other", label_type),
            T.StructField("total", T.DoubleType()),
            T.StructField("c", T.LongType()),
        ]
    )

    def masks(labels):
        return [(label, np.array([o == label for o in labels])) for label in dict.fromkeys(labels)]

    def side(ids, labels, others, totals):
        for (other, mask), total in zip(others, totals):
            yield pd.DataFrame(
                {
                    "row_id": list(ids),
                    "label": list(labels),
                    "other": [other] * len(ids),
                    "total": total,
                    "c": int(mask.sum()),
                }
            )

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                left, right = np.stack(row.l_x), np.stack(row.r_x)
                of_left, of_right = masks(row.l_labels), masks(row.r_labels)
                to_right, to_left = np.zeros((len(of_right), len(left))), np.zeros((len(of_left), len(right)))
                for part, dist in distances(left, right):
                    for m, (_, mask) in enumerate(of_right):
                        to_right[m, part] = dist[:, mask].sum(axis=1)
                    if row.br != row.bc:
                        for m, (_, mask) in enumerate(of_left):
                            to_left[m] += dist[mask[part]].sum(axis=0)
                yield from side(row.l_ids, row.l_labels, of_right, to_right)
                if row.br != row.bc:
                    yield from side(row.r_ids, row.r_labels, of_left, to_left)

    sums = (
        block_grid(vectors, size=size)
        .mapInPandas(run, out)
        .groupBy("row_id", "label", "other")
        .agg(F.sum("total").alias("total"), F.sum("c").alias("c"))
    )
    own = F.col("label") == F.col("other")
    parts = sums.groupBy("row_id", "label").agg(
        F.max(F.when(own, safe_div(F.col("total"), F.col("c") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("c"))).alias("b"),
    )
    s = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(
        safe_div(F.col("b") - F.col("a"), F.greatest("a", "b"), 0.0)
    )
    return parts.withColumn("s", s)


def silhouette(vectors: DataFrame, size: int = ROWS) -> DataFrame:
    score = silhouette_rows(vectors, size).agg(F.avg("s").alias("silhouette_score"))
    return score.withColumn("silhouette_interpretation", silhouette_label(F.col("silhouette_score")))


# Silhouette bands (strictly above) and their wording.
SILHOUETTE_BANDS = (
    (0.7, "Excelente separabilidad"),
    (0.5, "Buena separabilidad"),
    (0.3, "Separabilidad aceptable"),
)
SILHOUETTE_POOR = "Separabilidad pobre"


def silhouette_label(score):
    out = F.lit(SILHOUETTE_POOR)
    for floor, text in reversed(SILHOUETTE_BANDS):
        out = F.when(score > floor, text).otherwise(out)
    return out


def fisher_ratio(vectors: DataFrame) -> DataFrame:
    """Distance of the two centroids over the mean distance to the own centroid."""
    centres = (
        vectors.select("label", F.posexplode("x").alias("k", "v"))
        .groupBy("label", "k")
        .agg(F.avg("v").alias("m"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("k", "m")))["m"].alias("centre"))
    )

    def distance(left, right):
        squares = F.zip_with(left, right, lambda p, q: (p - q) * (p - q))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))

    intra = (
        vectors.join(centres, "label")
        .groupBy("label")
        .agg(F.avg(distance(F.col("x"), F.col("centre"))).alias("intra"))
    )
    both = centres.join(intra, "label").agg(
        F.array_sort(F.collect_list("centre")).alias("c"), F.avg("intra").alias("intra_class_distance")
    )
    inter = distance(F.col("c")[0], F.col("c")[1])
    return both.select(
        inter.alias("inter_class_distance"),
        "intra_class_distance",
        safe_div(inter, F.col("intra_class_distance")).alias("fisher_ratio"),
    )


def separability(pca_total, silhouette_score, fisher, pca_min=0.8, sil_min=0.3, fisher_min=1.5):
    """Struct of the three criteria and their conjunction, as a column."""
    checks = {
        "pca_variance": (pca_total, pca_min),
        "silhouette": (silhouette_score, sil_min),
        "fisher_ratio": (fisher, fisher_min),
    }
    passed = F.lit(True)
    for value, floor in checks.values():
        passed = passed & (value >= floor)
    return F.struct(
        *[
            F.struct(
                value.alias("value"), F.lit(floor).alias("threshold"), (value >= floor).alias("passed")
            ).alias(name)
            for name, (value, floor) in checks.items()
        ],
        passed.alias("validation_passed"),
    )


def family(name):
    """Descriptor family: the part of the name before the first underscore."""
    return F.split(name, "_")[0]


# Wording of the bands in a feature's justification.
WORDING = {
    "p < 0.001": "altamente significativa (p<0.001)",
    "p < 0.01": "muy significativa (p<0.01)",
    "otherwise": "significativa (p=%.3f)",
    "effect": "efecto %s (|d|=%.2f)",
    "F > 10": "alto poder discriminativo",
    "F > 5": "buen poder discriminativo",
    "lower": "poder discriminativo moderado",
}


def justification(p_value, d, f_score):
    """Short sentence for a selected feature, from bands of its statistics."""
    significance = (
        F.when(p_value < 0.001, WORDING["p < 0.001"])
        .when(p_value < 0.01, WORDING["p < 0.01"])
        .otherwise(F.format_string(WORDING["otherwise"], p_value))
    )
    effect = F.format_string(WORDING["effect"], effect_label(d), F.abs(d))
    strength = (
        F.when(f_score > 10, WORDING["F > 10"])
        .when(f_score > 5, WORDING["F > 5"])
        .otherwise(F.lit(WORDING["lower"]))
    )
    return F.concat_ws(", ", significance, effect, strength)


def dataset_summary(long: DataFrame) -> DataFrame:
    """Rows per class and the number of features: (label, rows, features)."""
    rows = long.groupBy("label", "row_id").agg(F.count(F.lit(1)).alias("p"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.max("p").alias("features"))
