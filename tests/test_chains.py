"""Whole chains: audio files to images, features to a selection, models to a comparison."""

import os

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from recurra.operators import classify, recurrence
from recurra.plans import audio_chain
from recurra.plans.feature_selection import SelectionConfig, select_features
from recurra.session import work_folder
from recurra.sources import audio, results


def test_audio_to_images(spark, tmp_path):
    t = np.arange(4000) / 8000
    os.makedirs(tmp_path / "Normal")
    tone = np.where((t > 0.1) & (t < 0.4), np.sin(2 * np.pi * 200 * t), 0)
    (tmp_path / "Normal" / "tone.wav").write_bytes(audio.wav_bytes(tone * 0.8, 8000))
    files = audio.list_audio(spark, str(tmp_path))
    series = audio_chain.audio_series(files).orderBy("i").collect()
    assert len(series) == 12500 and {r.n for r in series} == {12500}
    want = 0.8 * np.sin(2 * np.pi * 200 * np.arange(12500) / 25000)
    inside = slice(3000, 9000)
    assert np.abs(np.array([r.y for r in series])[inside] - want[inside]).max() < 0.01
    options = {"target": 300, "edge": 30, "frame": 256, "hop": 64}
    segment = audio_chain.audio_segments(files, **options)
    assert {(r.signal_id, r.n) for r in segment.collect()} == {("Normal_tone", 300)}
    tiles = audio_chain.audio_images(files, 3, 2, **options)
    assert recurrence.gray_counts(tiles).selectExpr("sum(c)").first()[0] == 296 * 296


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(120):
        late = k % 2
        base = rng.normal() + 1.5 * late
        rows.append((k, "Pathol" if late else "Normal", base, base + 0.01 * rng.normal(), rng.normal() + late, float(rng.normal()), 1.0))
    return spark.createDataFrame(rows, "row_id long, label string, a_one double, a_two double, b_one double, b_noise double, c_flat double")


def test_selection_by_phases(wide):
    names = wide.columns[2:]
    long = wide.unpivot(["row_id", "label"], names, "feature", "value")
    found = select_features(long, SelectionConfig(target=3))
    failed = [r.feature for r in found.rejected_by_p.orderBy("place").collect()]
    assert failed[-1] == "c_flat" and "a_one" not in failed
    redundant = {r.feature: r.correlated_with for r in found.rejected_by_redundancy.collect()}
    chosen = [r.feature for r in found.selected.orderBy("rank").collect()]
    assert len({"a_one", "a_two"} & set(chosen)) == 1 and "b_one" in chosen
    assert set(redundant) == {"a_one", "a_two"} - set(chosen) and set(redundant.values()) <= set(chosen)
    document = found.document.first()
    assert [f.feature for f in document.selected_features] == chosen and document.configuration.target == 3
    assert document.validation.criteria.fisher_ratio.value > 0


def test_nothing_is_selected_from_noise(spark):
    rows = [(k, "AB"[k % 2], "f", float(k // 2)) for k in range(20)]
    found = select_features(spark.createDataFrame(rows, "row_id long, label string, feature string, value double"))
    assert found.selected.count() == 0 and [r.feature for r in found.rejected_by_p.collect()] == ["f"]
    assert found.document.count() == 1


def test_model_comparison(wide):
    records = classify.classify(
        wide, {"all": ["a_one", "b_one", "b_noise"], "noise": ["b_noise"]}, ("naive_bayes", "knn", "logistic_regression")
    )
    assert len(records) == 6 and all(r["n_test"] == 24 and r["predict_time"] >= 0 for r in records)
    best, top = classify.best_results(records)
    assert top["subset"] == "all" and top["f1_score"] > 0.65 and set(best) == {"all", "noise"}
    assert all(r["roc_auc"] > 0.7 for r in records if r["subset"] == "all")


def test_store_listing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "image_id string, glcm_energy double")
    results.write_features(df, str(tmp_path), "glcm", "x1")
    results.write_features(df, str(tmp_path), "lbp", "y2")
    assert results.stored_descriptors(spark, str(tmp_path)) == [("glcm", "x1"), ("lbp", "y2")]
    assert results.read_features(spark, str(tmp_path), "glcm", "none") is None
    assert results.drop_stored(spark, str(tmp_path), "lbp") and not results.drop_stored(spark, str(tmp_path), "lbp")
    assert results.stored_descriptors(spark, str(tmp_path)) == [("glcm", "x1")]
    os.makedirs(tmp_path / "descriptor=bad" / "config_hash=z")
    with pytest.raises(AnalysisException):
        results.read_features(spark, str(tmp_path), "bad", "z")


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        work_folder(Session())
