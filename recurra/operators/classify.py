"""Splits, weights, classifiers and their comparison."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from . import learners, trees
from .chunks import ordered_index
from .grid import ROWS, block_grid, strips

HASH_CHUNKS = 4096


def subsets(selected: DataFrame, smallest: int = 3) -> DataFrame:
    """Feature subsets from (rank, feature): top_5, top_10, all_selected and families of enough members."""
    from .selection import family

    named = selected.select("rank", F.col("feature").cast("string").alias("feature"))
    tagged = named.withColumn(
        "subset",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("rank") <= 5, F.lit("top_5")),
                    F.when(F.col("rank") <= 10, F.lit("top_10")),
                    F.lit("all_selected"),
                    F.concat(family(F.col("feature")), F.lit("_only")),
                )
            )
        ),
    )
    return (
        tagged.groupBy("subset")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array_sort(F.collect_list(F.struct("rank", "feature")))["feature"].alias("features"),
        )
        .filter(~F.col("subset").like("%\\_only") | (F.col("n") >= smallest))
    )


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {', '.join(missing)}")
    return df


def shuffled_index(rows: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Position ``i`` of every row in a fixed pseudo-random order of its class of ``n`` rows.

    The order is that of md5(seed:key); its leading hex digits chunk a class over many tasks.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    hashed = rows.withColumn("_h", digest)
    chunk = F.conv(F.substring("_h", 1, 3), 16, 10).cast("long")
    return ordered_index(hashed, label, ["_h", key], chunk).drop("_h")


def stratified_split(
    rows: DataFrame, key: str = "row_id", label: str = "label", test: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: exactly round(test * n) rows of each class."""
    indexed = shuffled_index(rows, key, label, seed)
    return indexed.withColumn("is_test", F.col("i") < F.round(F.col("n") * test)).drop("i", "n")


def cv_folds(
    rows: DataFrame, key: str = "row_id", label: str = "label", folds: int = 10, seed: int = 42
) -> DataFrame:
    """Add ``fold``: every class spread evenly over the folds."""
    indexed = shuffled_index(rows, key, label, seed)
    return indexed.withColumn("fold", (F.col("i") % folds).cast("int")).drop("i", "n")


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (classes * n_class) per class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy(F.lit(0))
    weight = F.sum("c").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("c"))
    return counts.select(label, "c", weight.alias("weight"))


def gaussian_nb(train: DataFrame, test: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """Gaussian naive Bayes from long tables: (row_id, label, prediction, score).

    ``score`` is the probability of the larger label. Models are classes x features rows.
    """
    spread = train.groupBy("feature").agg(F.var_pop("value").alias("v"))
    extra = spread.agg(F.max("v") * smoothing).scalar()
    model = train.groupBy("label", "feature").agg(
        F.avg("value").alias("mu"), F.var_pop("value").alias("var")
    )
    model = model.withColumn("var", F.col("var") + extra).withColumnRenamed("label", "cls")
    sizes = train.select("row_id", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    prior = sizes.select(
        F.col("label").alias("cls"),
        F.log(F.col("c") / F.sum("c").over(Window.partitionBy(F.lit(0)))).alias("prior"),
    )
    gap = F.col("value") - F.col("mu")
    part = -0.5 * F.log(2 * math.pi * F.col("var")) - gap * gap / (2 * F.col("var"))
    scores = (
        test.join(model, "feature")
        .groupBy("row_id", "label", "cls")
        .agg(F.sum(part).alias("ll"))
        .join(prior, "cls")
        .withColumn("ll", F.col("ll") + F.col("prior"))
    )
    by_row = scores.groupBy("row_id", "label").agg(
        F.max(F.struct("ll", "cls")).alias("best"),
        F.max(F.struct("cls", "ll")).alias("top"),
        F.collect_list("ll").alias("all"),
    )
    evidence = F.aggregate("all", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("best.ll")))
    return by_row.select(
        "row_id",
        "label",
        F.col("best.cls").alias("prediction"),
        (F.exp(F.col("top.ll") - F.col("best.ll")) / evidence).alias("score"),
    )


def gaussian_nb_folds(rows: DataFrame, folds: list[int], smoothing: float = 1e-9) -> DataFrame:
    """Gaussian naive Bayes of every fold from rows(row_id, label, feature, value, fold): (row_id, label, fold, prediction, score).

    Each fold's moments are taken once; a training part is the merger of the other folds' moments.
    """
    own = rows.groupBy("fold", "label", "feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mu"), (F.var_pop("value") * F.count("value")).alias("m2")
    )
    each = stage(own).withColumn("job", F.explode(F.array(*[F.lit(f) for f in folds]))).filter("fold <> job")

    def merged(*keys: str) -> DataFrame:
        n, s = F.sum("n"), F.sum(F.col("n") * F.col("mu"))
        square = F.sum(F.col("m2") + F.col("n") * F.col("mu") * F.col("mu"))
        return each.groupBy(*keys).agg(n.alias("n"), (s / n).alias("mu"), F.greatest(square / n - (s / n) * (s / n), F.lit(0.0)).alias("var"))

    floor = merged("job", "feature").groupBy("job").agg((F.max("var") * smoothing).alias("floor"))
    counts = merged("job", "label", "feature").groupBy("job", "label").agg(F.max("n").alias("c"))
    prior = counts.withColumn("prior", F.log(F.col("c") / F.sum("c").over(Window.partitionBy("job")))).drop("c")
    model = merged("job", "label", "feature").join(floor, "job").join(prior, ["job", "label"])
    model = model.select(F.col("job").alias("fold"), F.col("label").alias("cls"), "feature", "mu", (F.col("var") + F.col("floor")).alias("var"), "prior")
    gap = F.col("value") - F.col("mu")
    part = -0.5 * F.log(2 * math.pi * F.col("var")) - gap * gap / (2 * F.col("var"))
    by_class = rows.join(stage(model), ["fold", "feature"]).groupBy("row_id", "label", "fold", "cls")
    scores = by_class.agg((F.sum(part) + F.max("prior")).alias("ll"))
    by_row = scores.groupBy("row_id", "label", "fold").agg(
        F.max(F.struct("ll", "cls")).alias("best"), F.max(F.struct("cls", "ll")).alias("top"), F.collect_list("ll").alias("all")
    )
    evidence = F.aggregate("all", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("best.ll")))
    score = F.exp(F.col("top.ll") - F.col("best.ll")) / evidence
    return by_row.select("row_id", "label", "fold", F.col("best.cls").alias("prediction"), score.alias("score"))


def neighbor_schema(test: DataFrame) -> T.StructType:
    """(row_id, label, d, n_id, n_label) with the types of the table."""
    kinds = test.schema
    return T.StructType(
        [
            T.StructField("row_id", kinds["row_id"].dataType),
            T.StructField("label", kinds["label"].dataType),
            T.StructField("d", T.DoubleType()),
            T.StructField("n_id", kinds["row_id"].dataType),
            T.StructField("n_label", kinds["label"].dataType),
        ]
    )


def neighbor_kernel(k: int, apart: str | None = None):
    """The k nearest right rows of every left row of each tile, as a function for mapInPandas."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                whole, right = np.stack(row.l_x), np.stack(row.r_x)
                ids, labels = np.asarray(row.r_ids), np.asarray(row.r_labels)
                for part in strips(len(whole)):
                    left = whole[part]
                    square = np.zeros((len(left), len(right)))
                    for j in range(left.shape[1]):
                        square += (left[:, j][:, None] - right[:, j][None, :]) ** 2
                    dist = np.sqrt(square)
                    if apart is not None:
                        mine, theirs = np.asarray(getattr(row, f"l_{apart}"))[part], np.asarray(getattr(row, f"r_{apart}"))
                        dist[mine[:, None] == theirs[None, :]] = np.inf
                    keep = min(k, dist.shape[1])
                    # only what is as near as the k-th is ordered
                    at, near = np.nonzero(~(dist > np.partition(dist, keep - 1, axis=1)[:, keep - 1 : keep]))
                    order = np.lexsort((ids[near], dist[at, near], at))
                    first = np.searchsorted(at, at)
                    order = order[np.arange(len(at)) - first < keep]
                    at, near = at[order], near[order]
                    found = pd.DataFrame(
                        {
                            "row_id": np.asarray(row.l_ids)[part][at],
                            "label": np.asarray(row.l_labels)[part][at],
                            "d": dist[at, near],
                            "n_id": ids[near],
                            "n_label": labels[near],
                        }
                    )
                    yield found[np.isfinite(found["d"])] if apart is not None else found

    return run


def knn_neighbors(train: DataFrame, test: DataFrame, k: int = 5, size: int = ROWS, apart: str | None = None) -> DataFrame:
    """The k nearest training rows of every test row: (row_id, label, d, n_label), exact.

    Vectors meet tile by tile; each tile keeps k candidates per test row. Rows with the same value in the integer
    column ``apart`` are no neighbours of each other.
    """
    more = () if apart is None else (apart,)
    found = block_grid(test, train, size=size, more=more).mapInPandas(neighbor_kernel(k, apart), neighbor_schema(test))
    order = Window.partitionBy("row_id").orderBy("d", "n_id")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def knn_vote(neighbors: DataFrame, positive=None) -> DataFrame:
    """Inverse-distance vote: (row_id, label, prediction, score of the positive or else the larger label).

    A zero distance outweighs everything else, as the limit of 1 / d demands.
    """
    exact = F.max((F.col("d") == 0).cast("int")).over(Window.partitionBy("row_id"))
    weight = F.when(F.col("_exact") == 1, (F.col("d") == 0).cast("double")).otherwise(1 / F.col("d"))
    votes = (
        neighbors.withColumn("_exact", exact)
        .withColumn("w", weight)
        .groupBy("row_id", "label", "n_label")
        .agg(F.sum("w").alias("w"))
    )
    largest = neighbors.agg(F.max("n_label")).scalar() if positive is None else F.lit(positive)
    return votes.groupBy("row_id", "label").agg(
        F.max(F.struct(F.col("w"), F.col("n_label")))["n_label"].alias("prediction"),
        (F.sum(F.when(F.col("n_label") == largest, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("score"),
    )


# --- models ------------------------------------------------------------------------------------

MODELS = (
    "logistic_regression", "naive_bayes", "knn", "decision_tree", "svm", "random_forest", "mlp", "xgboost",
)


def fitted(
    name: str, rows: DataFrame, labels: tuple, folds: list[int], width: int, trees_: int | None = None,
    rounds: int | None = None, seed: int = 42,
) -> Callable[[], DataFrame]:
    """Train one model per fold from rows(row_id, label, x, fold); what is returned predicts every row of these folds.

    A row trains the models of all folds but its own; rows of other folds train all of them. Predictions are
    (row_id, label, fold, prediction, score), the score belongs to the second of the two labels.
    """
    negative, positive = labels
    if name not in MODELS:
        raise ValueError(f"unknown model {name}; one of {', '.join(MODELS)}")
    inside = rows.filter(F.col("fold").isin(folds))

    def told(scored: DataFrame, cut: float = 0.5) -> DataFrame:
        called = F.when(F.col("score") > cut, F.lit(positive)).otherwise(F.lit(negative))
        return scored.select("row_id", "label", "fold", called.alias("prediction"), "score")

    if name == "naive_bayes":
        long = rows.select("row_id", "label", "fold", F.posexplode("x").alias("feature", "value"))
        flip = negative > positive
        found = gaussian_nb_folds(long, folds).filter(F.col("fold").isin(folds))
        return lambda: found.withColumn("score", 1 - F.col("score")) if flip else found
    if name == "knn":
        near = knn_neighbors(rows, inside, size=128 if rows.count() <= 4096 else ROWS, apart="fold")
        voted = knn_vote(stage(near), positive).join(inside.select("row_id", "fold").distinct(), "row_id")
        return lambda: voted.select("row_id", "label", "fold", "prediction", "score")
    if name in ("decision_tree", "random_forest", "xgboost"):
        rule = trees.rule_of(name, width, trees_, rounds, seed)
        model = trees.train(rows, positive, folds, rule)
        return lambda: told(trees.predict(model, rows, rule.boosted))
    if name == "logistic_regression":
        weights = learners.logistic(rows, positive, folds)
        return lambda: told(learners.scored(inside, weights, learners.logistic_score))
    if name == "svm":
        machines = learners.machine(rows, positive, folds)
        return lambda: told(learners.scored(inside, machines, learners.machine_score), 0.0)
    networks = learners.perceptron(rows, positive, folds, learners.Network(seed=seed))
    return lambda: told(learners.scored(inside, networks, learners.network_score))


def standardized(vectors: DataFrame) -> DataFrame:
    """Vectors (row_id, label, x) with every component at mean 0 and population deviation 1; constant ones become 0.

    The means and deviations, two numbers per component, are literals of the plan.
    """
    parts = vectors.select(F.posexplode("x").alias("k", "v"))
    scale = parts.groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation")).orderBy("k").collect()
    if not scale:
        return vectors
    known = F.array(*[F.struct(F.lit(r.mean).alias("mean"), F.lit(r.deviation).alias("deviation")) for r in scale])
    shifted = F.zip_with(
        "x", known, lambda v, s: F.when(s["deviation"] > 0, (v - s["mean"]) / s["deviation"]).otherwise(F.lit(0.0))
    )
    return vectors.withColumn("x", shifted)


def classify(df: DataFrame, subsets: dict[str, list[str]], models=MODELS, positive=None, folds: int = 0, seed: int = 42, options: dict | None = None) -> list[dict]:
    """Compare models on feature subsets of a wide table (row_id, label, features): one record per subset and model.

    All rows are standardised, then split by class, fitted and scored: accuracy, precision, recall, F1, ROC-AUC, both
    times and, with folds, the mean and deviation of the cross-validated F1. ``best_results`` picks from the records.
    """
    from .evaluate import confusion, roc_auc, weighted_scores

    kinds = sorted(row.label for row in df.select("label").distinct().collect())
    if len(kinds) != 2:
        raise ValueError(f"two classes are compared, not {len(kinds)}")
    labels = tuple(kinds) if positive in (None, kinds[1]) else tuple(reversed(kinds))
    records = []
    for subset, features in subsets.items():
        require_columns(df, features)
        x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
        vectors = stage(standardized(df.select("row_id", "label", x.alias("x"))))
        rows = stage(stratified_split(vectors, seed=seed))
        train, test = rows.filter("NOT is_test").drop("is_test"), rows.filter("is_test").drop("is_test")
        for name in models:
            own = (options or {}).get(name, {})
            found, times = fit_predict(name, train, test, labels, len(features), **own)
            scores = weighted_scores(confusion(found)).first().asDict()
            record = {"subset": subset, "model_name": name, "n_train": train.count(), "n_test": test.count(), **scores, **times}
            record["roc_auc"] = roc_auc(found, labels[1]).first()["roc_auc"]
            if folds:
                record["cv_f1_mean"], record["cv_f1_std"] = cross_validate(name, vectors, labels, len(features), folds, **own)
            records.append(record)
    return records


def best_results(records: list[dict], metric: str = "f1_score") -> tuple[dict[str, dict], dict | None]:
    """The best record of every subset and the best of all; ties go to the model that sorts first."""
    ranked = sorted(records, key=lambda r: (-r[metric], r["subset"], r["model_name"]))
    best: dict[str, dict] = {}
    for record in ranked:
        best.setdefault(record["subset"], record)
    return best, (ranked[0] if ranked else None)


def width_of(vectors: DataFrame) -> int:
    """Number of components; vectors of different lengths are an error."""
    row = vectors.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if row.least != row.most:
        raise ValueError(f"vectors have {row.least} to {row.most} components")
    return row.most


def fit_predict(
    name: str, train: DataFrame, test: DataFrame, labels: tuple, width: int | None = None, **options
) -> tuple[DataFrame, dict]:
    """Predictions (row_id, label, prediction, score) of one model and its wall-clock times.

    ``train`` and ``test`` are vectors; ``labels`` is (negative, positive). Scoring is timed as the action that it is.
    """
    width = width if width is not None else width_of(train)
    started = time.perf_counter()
    columns = ("row_id", "label", "x")
    parts = [part.select(*columns, F.lit(fold).alias("fold")) for part, fold in ((train, -1), (test, 0))]
    predictions = fitted(name, stage(parts[0].unionByName(parts[1])), labels, [0], width, **_named(options))
    done = time.perf_counter()
    found = stage(predictions().drop("fold"))
    return found, {"train_time": done - started, "predict_time": time.perf_counter() - done}


def _named(options: dict) -> dict:
    return {"trees_" if k == "trees" else k: v for k, v in options.items()}


def fold_predictions(
    name: str, vectors: DataFrame, labels: tuple, width: int | None = None, folds: int = 10, **options
) -> DataFrame:
    """Every row predicted by the model trained on the other folds: (row_id, label, fold, prediction, score)."""
    rows = vectors if "fold" in vectors.columns else stage(cv_folds(vectors, folds=folds))
    width = width if width is not None else width_of(rows)
    return fitted(name, rows, labels, list(range(folds)), width, **_named(options))()


def predict_folds(
    names, vectors: DataFrame, labels: tuple, width: int | None = None, folds: int = 10, parallelism: int = 4
) -> dict[str, DataFrame]:
    """Written ``fold_predictions`` of several models, ``parallelism`` of them trained side by side.

    A model leaves cores idle between its passes and in its last tasks; jobs of other models fill them.
    """
    rows = vectors if "fold" in vectors.columns else stage(cv_folds(vectors, folds=folds))
    width = width if width is not None else width_of(rows)

    @inheritable_thread_target(vectors.sparkSession)
    def one(name: str) -> DataFrame:
        return stage(fold_predictions(name, rows, labels, width, folds))

    with ThreadPool(parallelism) as pool:
        return dict(zip(names, pool.map(one, names, chunksize=1)))


def fold_scores(predictions: DataFrame) -> DataFrame:
    """Mean and population deviation of the folds' weighted F1: one row (cv_f1_mean, cv_f1_std)."""
    from .evaluate import weighted_f1_by

    by_fold = weighted_f1_by(predictions, "fold")
    return by_fold.agg(F.avg("f1_score").alias("cv_f1_mean"), F.stddev_pop("f1_score").alias("cv_f1_std"))


def cross_validate(
    name: str, vectors: DataFrame, labels: tuple, width: int | None = None, folds: int = 10, **options
) -> tuple[float, float]:
    """Mean and population deviation of the weighted F1 over stratified folds."""
    row = fold_scores(fold_predictions(name, vectors, labels, width, folds, **options)).first()
    return row.cv_f1_mean, row.cv_f1_std
