"""One far value, one dense hour, many ties: chunks stay even and results exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.operators import chunks, evaluate, recurrence, selection
from recurra.sources.tables import signal_from_events


@pytest.fixture
def many_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_ranges_are_even_beside_a_far_value(spark, many_ranges):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=8000), [1e15]])
    df = spark.createDataFrame([("f", float(v)) for v in values], "feature string, value double")
    sizes = [r["count"] for r in chunks.range_chunks(df, ["feature"], ["value"]).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 8001 / 8


def test_scores_ranks_and_information_beside_a_far_value(spark, many_ranges):
    rng = np.random.default_rng(5)
    score = np.concatenate([np.round(rng.normal(size=600), 2), [-1e12]])
    label = np.where(score + rng.normal(size=601) > 0, "P", "N")
    df = spark.createDataFrame([(i, str(a), float(s)) for i, (a, s) in enumerate(zip(label, score))], "row_id long, label string, score double")
    p, n = score[label == "P"], score[label == "N"]
    want = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
    assert abs(evaluate.roc_auc(df, "P").first().roc_auc - want) < 1e-12
    points = [(r.tpr, r.fpr) for r in evaluate.roc_points(df, "P").orderBy(F.desc("score")).collect()]
    assert points == sorted(points) and points[-1] == (1.0, 1.0)
    long = df.select("row_id", "label", F.lit("f").alias("feature"), F.col("score").alias("value"))
    ranks = {r.row_id: r.value for r in selection.average_ranks(long).collect()}
    for i in range(0, 601, 60):
        assert ranks[i] == (score < score[i]).sum() + ((score == score[i]).sum() + 1) / 2
    moved = long.withColumn("value", F.when(F.col("value") < -1e9, -50.0).otherwise(F.col("value")))
    near, far = (selection.knn_information(t).first().mi_score for t in (moved, long))
    assert abs(near - far) < 0.02


@pytest.mark.parametrize("far", [1e3, 1e9, 1e300])
def test_quantiles_beside_a_far_value(spark, far):
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.normal(size=3000), [far], np.zeros(200)])
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("one", 5.0)], "g string, v double")
    found = {r.g: r for r in chunks.exact_quantiles(df, "g", "v", {"q1": 0.25, "q2": 0.5, "q9": 0.99}).collect()}
    assert np.allclose([found["g"][c] for c in ("q1", "q2", "q9")], np.quantile(values, [0.25, 0.5, 0.99]), rtol=1e-12)
    assert found["g"].n == 3201 and found["one"].q1 == found["one"].q9 == 5.0


@pytest.mark.parametrize("listed", [0, 5, 1 << 16])
def test_percentile_of_distances_by_levels(series, listed):
    rng = np.random.default_rng(7)
    data = {"noise": rng.normal(size=80), "far": np.append(rng.normal(size=60), 1e9), "flat": np.ones(30), "steps": rng.integers(0, 3, 70).astype(float)}
    found = {r.signal_id: r for r in recurrence.epsilon_percentile(series(data), 2, 1, 30.0, size=16, listed=listed).collect()}
    for key, y in data.items():
        points = np.stack([y[:-1], y[1:]], axis=1)
        d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))[np.triu_indices(len(points), 1)]
        assert found[key].n == len(d) and found[key].eps == pytest.approx(np.percentile(d, 30), rel=1e-12)


def test_a_dense_hour_is_cut(spark, many_ranges):
    rows = [(k, f"2024-01-01 00:{k % 60:02d}:00", k % 2, float(k)) for k in range(4000)] + [(9000, "2024-01-05 00:00:00", 0, 1.0)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.to_timestamp("ts"))
    hourly, ranged = (sorted(map(tuple, signal_from_events(events, hours=h).collect())) for h in (1, None))
    assert hourly == ranged and len(hourly) == 4001


def test_binned_information_by_hand(spark):
    rng = np.random.default_rng(9)
    value, label = np.round(rng.normal(size=200), 1), rng.choice(["N", "P"], 200)
    rows = [(i, str(a), name, float(x)) for i, (a, v) in enumerate(zip(label, value)) for name, x in (("f", v), ("flat", 3.0))]
    found = selection.binned_information(spark.createDataFrame(rows, "row_id long, label string, feature string, value double"))
    slot = np.minimum(np.floor((value - value.min()) / (value.max() - value.min()) * 10), 9)
    want = 0.0
    for b in np.unique(slot):
        for a in ("N", "P"):
            c = ((slot == b) & (label == a)).sum()
            want += c / 200 * np.log(c * 200 / ((slot == b).sum() * (label == a).sum())) if c else 0.0
    got = {r.feature: r.mi_score for r in found.collect()}
    assert abs(got["f"] - want) < 1e-12 and got["flat"] == 0.0
