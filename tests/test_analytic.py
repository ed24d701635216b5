"""Small inputs whose answers follow from the definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.functions import f_survival
from recurra.operators import (
    classify, evaluate, framework, params, recurrence, rqa, segment, selection, tamura, texture, wavelet,
)


def by_lag(df):
    return {r.lag: r.value for r in df.collect()}


def test_takens(series):
    rows = params.takens(series({"a": range(6)}), 3, 2).orderBy("i").collect()
    assert [(r.x0, r.x1, r.x2) for r in rows] == [(0, 2, 4), (1, 3, 5)]


def test_autocorrelation_and_crossing(series):
    curve = params.autocorrelation(series({"a": [1, 2, 3, 4]}), 3)
    assert by_lag(curve) == pytest.approx({1: 0.25, 2: -0.30, 3: -0.45})
    assert params.first_zero_crossing(curve).first().tau == 1


def test_mutual_information_alternating(series):
    assert by_lag(params.mutual_information(series({"a": [0, 1, 0, 1]}), 1)) == pytest.approx({1: math.log(2)})


@pytest.mark.parametrize("values, tau", [([3, 1, 2, 0], 2), ([3, 2, 1], 3)])
def test_first_local_minimum(spark, values, tau):
    curve = spark.createDataFrame(
        [("a", k + 1, float(v)) for k, v in enumerate(values)], "signal_id string, lag int, value double"
    )
    assert params.first_local_minimum(curve).first().tau == tau


def test_constant_series(series):
    flat = series({"a": [2.5] * 40})
    assert set(by_lag(params.mutual_information(flat, 3)).values()) == {0.0}
    acf = params.autocorrelation(flat, 3)
    assert by_lag(acf) == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert params.first_zero_crossing(acf).first().tau is None
    fnn = params.false_neighbors(flat, 3, 1)
    assert set(by_lag(fnn).values()) == {0.0}
    assert params.choose_dimension(fnn, dim_max=3).first().dim == 1
    counts = recurrence.gray_counts(recurrence.recurrence_tiles(flat, 2, 1)).collect()
    assert [(r.v, r.c) for r in counts] == [(0, 39 * 39)]


def test_blocks_do_not_change_results(series):
    rng = np.random.default_rng(7)
    data = series({"a": rng.normal(size=57), "b": rng.normal(size=33)})
    small = {(r.signal_id, r.d, r.i): (r.j, r.dist) for r in params.nearest_neighbors(data, 3, 2, 8).collect()}
    whole = {(r.signal_id, r.d, r.i): (r.j, r.dist) for r in params.nearest_neighbors(data, 3, 2).collect()}
    assert small == whole
    eps_small = recurrence.epsilon_percentile(data, 3, 2, size=7).orderBy("signal_id").collect()
    assert eps_small == recurrence.epsilon_percentile(data, 3, 2).orderBy("signal_id").collect()


@pytest.mark.parametrize(
    "n, active, head, tail, want",
    [
        (300, (0, 300), 1.0, 2.0, (50, 300, 0, "trim")),
        (300, (0, 300), 2.0, 1.0, (0, 250, 0, "trim")),
        (300, (10, 20), 1.0, 1.0, (0, 250, 0, "extend")),
        (100, (0, 100), 1.0, 1.0, (0, 100, 150, "short")),
        (300, None, 1.0, 1.0, (0, 250, 0, "silent")),
    ],
)
def test_window_choice(spark, series, n, active, head, tail, want):
    values = [head] * 25 + [0.5] * (n - 50) + [tail] * 25
    sig = series({"a": values})
    spans = spark.createDataFrame([("a", *active)] if active else [], "signal_id string, s long, e long")
    row = segment.choose_window(sig, spans, 250, 25).first()
    assert (row.lo, row.hi, row.pad, row.case) == want
    assert segment.cut_segment(sig, segment.choose_window(sig, spans, 250, 25)).count() == 250


def test_all_ones_recurrence(spark, picture):
    tiles = picture({"a": np.zeros((4, 4))})
    level = spark.createDataFrame([("a", 0.0)], "image_id string, level double")
    m = rqa.rqa_measures(rqa.recurrence_runs(tiles, level)).first()
    assert m.rqa_RR == 1 and m.rqa_DET == pytest.approx(10 / 16)
    assert (m.rqa_L_max, m.rqa_L_mean, m.rqa_ENTR) == (3, 2.5, 1)
    assert (m.rqa_LAM, m.rqa_V_max, m.rqa_TT) == (1, 4, 4) and m.rqa_DIV == pytest.approx(1 / 3)


def test_identity_recurrence(spark, picture):
    tiles = picture({"a": 255 - 255 * np.eye(12)})
    level = spark.createDataFrame([("a", 0.0)], "image_id string, level double")
    m = rqa.rqa_measures(rqa.recurrence_runs(tiles, level)).first()
    assert m.rqa_RR == pytest.approx(1 / 12)
    assert (m.rqa_DET, m.rqa_L_max, m.rqa_LAM, m.rqa_DIV) == (0, 0, 0, None)


def test_runs_cross_tile_borders(spark, picture):
    rng = np.random.default_rng(3)
    img = (rng.random((37, 37)) > 0.6) * 255
    level = spark.createDataFrame([("a", 0.0)], "image_id string, level double")
    runs = [
        sorted((r.dir, r.len, r.c) for r in rqa.recurrence_runs(picture({"a": img}, size), level).collect())
        for size in (5, 16, 64)
    ]
    assert runs[0] == runs[1] == runs[2]


def test_cooccurrence_checkerboard(picture):
    f = texture.glcm_features(picture({"a": [[0, 1], [1, 0]]}), 256).first()
    assert f.glcm_contrast == f.glcm_dissimilarity == 0.5
    assert (f.glcm_homogeneity, f.glcm_ASM, f.glcm_correlation) == (0.75, 0.75, 0.0)
    assert f.glcm_energy == pytest.approx(0.853553, abs=1e-6)


def test_binary_pattern_constant(picture):
    f = texture.lbp_features(picture({"a": np.full((3, 3), 5)})).first()
    assert [f[f"lbp_hist_bin_{k}_r1_p4"] for k in range(6)] == pytest.approx([0, 0, 4 / 9, 4 / 9, 1 / 9, 0])
    assert f.lbp_uniform_ratio_r1_p4 == pytest.approx(8 / 9)
    assert f.lbp_nonuniform_ratio_r1_p4 == pytest.approx(1 / 9)


def test_statistics_two_pixels(picture):
    f = texture.stat_features(picture({"a": [[0, 255]]})).first()
    assert (f.stat_mean, f.stat_std, f.stat_skewness, f.stat_kurtosis) == (127.5, 127.5, 0, -2)
    assert (f.stat_p10, f.stat_range, f.stat_cv, f.stat_iqr) == (25.5, 255, 1, 127.5)
    assert f.stat_hist_bin_0 == f.stat_hist_bin_63 == pytest.approx(0.1254902, abs=1e-6)
    assert f.stat_entropy == pytest.approx(0.751524, abs=1e-6) and f.stat_hist_effective_bins == 2


def test_haar_constant(picture):
    stats = {r.band: r for r in wavelet.subband_stats(picture({"a": np.full((16, 16), 9)}), "haar", 2).collect()}
    assert stats["approx_L2"].mean == pytest.approx(9 * 4)
    assert all(abs(r.energy) < 1e-20 for b, r in stats.items() if b.startswith("detail"))


def test_wavelet_energy_ratios_sum_to_one(picture):
    rng = np.random.default_rng(5)
    tiles = recurrence.with_halo(picture({"a": rng.integers(0, 256, (80, 80))}, 32), wavelet.halo_for("db4", 3))
    f = wavelet.wavelet_features(tiles).first()
    assert f.wavelet_ratio_approx_total + f.wavelet_ratio_detail_total == pytest.approx(1)
    assert len(f) == 66


def test_effect_size_and_identity(spark):
    rows = [(k, c, 0, float(v)) for k, (c, v) in enumerate([("A", 1), ("A", 2), ("A", 3), ("B", 3), ("B", 4), ("B", 5)])]
    stats = selection.class_stats(spark.createDataFrame(rows, "row_id long, label string, feature int, value double"))
    effect = selection.cohens_d(stats).first()
    assert effect.cohens_d == pytest.approx(-2) and effect.effect_size == "large"
    f = selection.anova(stats).first().f_score
    assert f == pytest.approx(6) == pytest.approx(effect.cohens_d**2 * 9 / 6)


def test_f_tail(spark):
    df = spark.createDataFrame([(62.6, 1.0, 438.0), (1.0, 1.0, 1.0), (0.0, 2.0, 5.0)], "f double, a double, b double")
    p = [r.p for r in df.select(f_survival("f", "a", "b").alias("p")).collect()]
    assert p[0] == pytest.approx(2.087e-14, rel=1e-3) and p[1:] == pytest.approx([0.5, 1.0])


def test_area_under_curve(spark):
    rows = [(1, "p", 0.9), (2, "n", 0.8), (3, "p", 0.7), (4, "n", 0.1)]
    df = spark.createDataFrame(rows, "row_id long, label string, score double")
    assert evaluate.roc_auc(df, "p").first().roc_auc == 0.75
    points = {r.score: (r.tpr, r.fpr) for r in evaluate.roc_points(df, "p").collect()}
    assert points == {0.9: (0.5, 0), 0.8: (0.5, 0.5), 0.7: (1, 0.5), 0.1: (1, 1)}


def test_redundancy(spark):
    ranked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "rank int, feature string")
    r = {("a", "b"): 0.97, ("a", "c"): 0.38, ("b", "c"): 0.2}
    pairs = [(x, y, 1.0 if x == y else r.get((x, y), r.get((y, x)))) for x in "abc" for y in "abc"]
    found = selection.drop_redundant(ranked, spark.createDataFrame(pairs, "a string, b string, r double")).collect()
    assert [(x.feature, x.kept, x.correlated_with) for x in found] == [("a", True, None), ("b", False, "a"), ("c", True, None)]


def test_smoothed_speed(spark):
    rows = [("s", 0, 0.0, 0.0), ("s", 1, 10.0, 1.0), ("s", 2, 30.0, 2.0), ("s", 3, 30.0, 3.0), ("s", 4, 5.0, 4.0)]
    df = spark.createDataFrame(rows, "signal_id string, i long, processed double, at double")
    found = [r.speed for r in framework.smoothed_speed(df).orderBy("i").collect()]
    assert found == [0.0, 10.0, 17.0, 17.0, 0.0]


def test_subsets(spark):
    names = ["lbp_a", "lbp_b", "lbp_c", "glcm_a", "rqa_a", "rqa_b"]
    df = spark.createDataFrame([(k + 1, n) for k, n in enumerate(names)], "rank int, feature string")
    found = {r.subset: r.features for r in classify.subsets(df).collect()}
    assert found == {"top_5": names[:5], "top_10": names, "all_selected": names, "lbp_only": names[:3]}


def test_effect_needs_two_classes(spark):
    rows = [(k, c, 0, float(k)) for k, c in enumerate("ABC")]
    stats = selection.class_stats(spark.createDataFrame(rows, "row_id long, label string, feature int, value double"))
    with pytest.raises(Exception, match="two classes"):
        selection.cohens_d(stats).collect()


def test_tamura_constant(picture):
    m = tamura.measures(picture({"a": np.full((32, 32), 7)})).first()
    assert (m.coarseness, m.directionality, m.linelikeness) == (1.0, 0.0, 0.0)


def test_failed_loads_abort(spark):
    loads = spark.range(12).withColumn("status", F.lit("failed"))
    with pytest.raises(Exception, match="too many"):
        framework.fail_after(loads, 10).collect()
