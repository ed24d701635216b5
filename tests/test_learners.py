"""Fold-parallel learners against solutions from their definitions, and both ways of training against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.operators import learners


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(21)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.8 * x[:, 2] * x[:, 3] + rng.normal(scale=0.4, size=500) > 0.2).astype(float)
    return x, y, np.arange(500) % 4


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, fold = data
    table = [(i, "NP"[int(y[i])], [float(v) for v in x[i]], int(fold[i])) for i in range(len(y))]
    return spark.createDataFrame(table, "row_id long, label string, x array<double>, fold int").repartition(3).cache()


def test_logistic_regression_has_no_slope_left(rows, data):
    x, y, fold = data
    models = learners.logistic(rows, "P", [0, 1, 2, 3])
    full = np.hstack([x, np.ones((500, 1))])
    for f, w in models.items():
        inside = fold != f
        n, p = inside.sum(), y[inside].sum()
        weight = np.where(y == 1, n / (2 * p), n / (2 * (n - p))) * inside
        slope = w + full.T @ (weight * (1 / (1 + np.exp(-full @ w)) - y))
        assert np.abs(slope).max() < 1e-5
    alone = learners.logistic(rows, "P", [2])
    assert np.allclose(alone[2], models[2], atol=1e-9)
    scored = learners.scored(rows, models, learners.logistic_score).collect()
    assert len(scored) == 500
    for r in scored[:50]:
        assert abs(r.score - 1 / (1 + np.exp(-full[r.row_id] @ models[r.fold]))) < 1e-12


def conditions(model, x, y, bound):
    """Largest violation of the optimality conditions of the dual, from support vectors alone."""
    sign = np.where(y == 1, 1.0, -1.0)
    margin = sign * learners.machine_score(model, x)
    place = {tuple(v): c for v, c in zip(model["support"], model["coefficient"])}
    alpha = np.array([abs(place.get(tuple(v), 0.0)) for v in x])
    assert (alpha <= bound + 1e-9).all() and abs((alpha * sign).sum()) < 1e-9
    worst = np.where(alpha < 1e-9, np.maximum(1 - margin, 0), np.where(alpha > bound - 1e-9, np.maximum(margin - 1, 0), np.abs(margin - 1)))
    return worst.max()


def test_exact_machine_meets_the_dual_conditions(rows, data):
    x, y, fold = data
    models = learners.machine(rows, "P", [0, 3])
    for f, model in models.items():
        inside = fold != f
        n, p = inside.sum(), y[inside].sum()
        bound = 10 * np.where(y[inside] == 1, n / (2 * p), n / (2 * (n - p)))
        assert conditions(model, x[inside], y[inside], bound) < 2e-4
        assert 0 < len(model["support"]) < n


def test_machine_is_exact_beyond_the_kernel_that_a_task_holds(rows, data, monkeypatch):
    x, y, fold = data
    monkeypatch.setattr(learners, "EXACT_ROWS", 100)
    models = learners.machine(rows, "P", [0])
    inside = fold != 0
    n, p = inside.sum(), y[inside].sum()
    bound = 10 * np.where(y[inside] == 1, n / (2 * p), n / (2 * (n - p)))
    assert conditions(models[0], x[inside], y[inside], bound) < 2e-4
    sign, gamma = np.where(y[inside] == 1, 1.0, -1.0), models[0]["gamma"]
    alpha, constant = learners.dual_blocks(x[inside], gamma, sign, bound, working=40)
    used = alpha > 0
    model = {"support": x[inside][used], "coefficient": (alpha * sign)[used], "constant": constant, "gamma": gamma}
    assert conditions(model, x[inside], y[inside], bound) < 2e-4
    assert np.allclose(learners.machine_score(model, x), learners.machine_score(models[0], x), atol=1e-3)


def test_landmarks_come_close_to_the_exact_machine(rows, data):
    x, y, _ = data
    train = rows.withColumn("fold", F.lit(-1))
    exact = learners.machine(train, "P", [0], strength=1.0)[0]
    many = learners.machine(train, "P", [0], strength=1.0, exact_rows=100, landmarks=500)[0]
    few = learners.machine(train, "P", [0], strength=1.0, exact_rows=100, landmarks=20)[0]
    assert many["residual"] < 1e-6 and few["residual"] > 0.05
    gaps = np.abs(learners.machine_score(exact, x) - learners.machine_score(many, x))
    assert gaps.max() < 0.02
    assert np.mean((learners.machine_score(many, x) > 0) == (learners.machine_score(exact, x) > 0)) > 0.97


def test_gradients_are_differences(data):
    x, y, _ = data
    net = learners.Network(hidden=(5, 4))
    weights = net.start(6)
    sums, _ = learners.gradient_sums(weights, x[:40], y[:40])
    for k, w in enumerate(weights):
        for at in list(np.ndindex(w.shape))[:6]:
            near = []
            for sign in (1, -1):
                moved = [v.copy() for v in weights]
                moved[k][at] += sign * 1e-6
                near.append(learners.gradient_sums(moved, x[:40], y[:40])[1])
            assert abs((near[0] - near[1]) / 2e-6 - sums[k][at]) < 1e-4


def test_gradients_over_tasks_follow_the_single_process(rows, data):
    x, y, fold = data
    net = learners.Network(hidden=(8, 4), epochs=4, batch=150, most_steps=3)
    spread = learners.perceptron(rows, "P", [0, 1], net, local_bytes=0)
    for f in (0, 1):
        keys = {r.row_id: r.k for r in rows.select("row_id", F.xxhash64("row_id").alias("k")).collect()}
        inside = np.flatnonzero(fold != f)
        part = learners.Rows(x[inside], y[inside], fold[inside], np.array([keys[i] for i in inside.tolist()]))
        single = learners.network_of(part, net, steps=3)
        assert np.allclose(spread[f]["losses"], single["losses"], atol=1e-9)
        for a, b in zip(spread[f]["weights"], single["weights"]):
            assert np.allclose(a, b, atol=1e-9)


def test_sets_of_medium_size_take_the_same_steps_in_one_task(rows, monkeypatch):
    net = learners.Network(hidden=(8, 4), epochs=4, batch=150, most_steps=2)
    spread = learners.perceptron(rows, "P", [0, 1], net, local_bytes=0)
    monkeypatch.setattr(learners, "LOCAL_BYTES", 0)
    monkeypatch.setattr(learners, "networks_over_tasks", lambda *a: pytest.fail("a job for every batch of a set that a task holds"))
    alone = learners.perceptron(rows, "P", [0, 1], net)
    for f in (0, 1):
        assert np.allclose(alone[f]["losses"], spread[f]["losses"], atol=1e-9)
        for a, b in zip(alone[f]["weights"], spread[f]["weights"]):
            assert np.allclose(a, b, atol=1e-9)


def test_batches_of_an_epoch_follow_from_the_rows_alone(rows, monkeypatch):
    net = learners.Network(hidden=(8, 4), epochs=3, batch=10)  # 34 batches
    whole = learners.perceptron(rows, "P", [0, 1], net)
    monkeypatch.setattr(learners, "LOCAL_BYTES", 0)
    again = learners.perceptron(rows, "P", [0, 1], net)
    for f in (0, 1):
        assert whole[f]["losses"] == again[f]["losses"]
        for a, b in zip(whole[f]["weights"], again[f]["weights"]):
            assert np.array_equal(a, b)


def test_rows_of_a_file_are_those_of_memory(rows):
    net = learners.Network(hidden=(8, 4), epochs=3, batch=50)
    batches = learners.coded_rows(rows, "P").toArrow().to_batches(max_chunksize=60)
    short, long = learners.rows_of(batches), learners.held_rows(iter(batches), 0)
    for name in ("x", "y", "fold", "key"):
        assert np.array_equal(getattr(short, name), getattr(long, name))
    assert learners.network_of(short, net)["losses"] == learners.network_of(long, net)["losses"]
    assert len(learners.held_rows(iter([]), 0).y) == 0


def test_perceptron_learns_and_stops_early(rows, data):
    models = learners.perceptron(rows, "P", [0, 1, 2, 3])
    assert all(15 < len(m["losses"]) < 800 and m["losses"][-1] < m["losses"][0] for m in models.values())
    patient = learners.perceptron(rows, "P", [0, 1, 2, 3], learners.Network(batch=20, patience=40))
    assert all(m["losses"][-1] < 0.5 * m["losses"][0] for m in patient.values())
    found = learners.scored(rows, patient, learners.network_score).collect()
    assert np.mean([(r.score > 0.5) == (r.label == "P") for r in found]) > 0.8


@pytest.mark.parametrize("name", ["naive_bayes", "knn", "decision_tree", "svm", "random_forest", "mlp", "xgboost", "logistic_regression"])
def test_fold_scores_are_those_of_single_fits(rows, name):
    from recurra.operators import classify

    options = {"random_forest": {"trees": 20}, "xgboost": {"rounds": 10}}.get(name, {})
    together = {r.row_id: r for r in classify.fold_predictions(name, rows, ("N", "P"), 6, 4, **options).collect()}
    assert len(together) == 500
    train, test = rows.filter("fold <> 2").drop("fold"), rows.filter("fold = 2").drop("fold")
    alone, times = classify.fit_predict(name, train, test, ("N", "P"), 6, **options)
    for r in alone.collect():
        assert r.prediction == together[r.row_id].prediction and abs(r.score - together[r.row_id].score) < 1e-6
    assert set(times) == {"train_time", "predict_time"}
    assert np.mean([r.prediction == r.label for r in together.values()]) > 0.6


def test_weighted_f1_by_fold(spark):
    from recurra.operators import classify, evaluate

    rng = np.random.default_rng(2)
    table = [(int(f), "ab"[a], "ab"[b]) for f, a, b in zip(rng.integers(0, 3, 200), rng.integers(0, 2, 200), rng.integers(0, 2, 200))]
    table += [(3, "a", "a"), (3, "a", "a"), (4, "a", "b")]
    df = spark.createDataFrame(table, "fold int, label string, prediction string")
    got = {r.fold: r.f1_score for r in evaluate.weighted_f1_by(df, "fold").collect()}
    for f in range(5):
        own = df.filter(F.col("fold") == f)
        want = evaluate.weighted_scores(evaluate.confusion(own)).first().f1_score
        assert abs(got[f] - want) < 1e-12
    row = classify.fold_scores(df).first()
    assert abs(row.cv_f1_mean - np.mean(list(got.values()))) < 1e-12 and abs(row.cv_f1_std - np.std(list(got.values()))) < 1e-12
