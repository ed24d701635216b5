"""Operators without a SQL equivalent against direct NumPy computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.operators import inversions, classify, gabor, params, recurrence, segment, selection, tamura, texture


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(60, 4)), 1)
    x[:30, 0] += 1.5
    labels = ["A"] * 30 + ["B"] * 30
    rows = [(k, labels[k], [float(v) for v in x[k]]) for k in range(60)]
    return x, labels, spark.createDataFrame(rows, "row_id long, label string, x array<double>")


def test_kendall(table):
    x, _, df = table
    signs = [np.sign(x[:, None, k] - x[None, :, k])[np.triu_indices(60, 1)] for k in range(4)]
    for r in selection.correlation_matrix(df, "kendall").collect():
        a, b = signs[r.a], signs[r.b]
        assert r.r == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)))


@pytest.mark.parametrize("n, size", [(700, 64), (700, 1 << 15), (1, 64), (2, 1)])
def test_inversions_over_chunks_with_ties(spark, n, size):
    rng = np.random.default_rng(n)
    x = np.stack([rng.normal(size=n), rng.integers(0, 6, n), np.where(rng.random(n) < 0.5, 0.0, rng.normal(size=n)), np.ones(n)], axis=1)
    x[:, 1] += np.round(x[:, 0])
    df = spark.createDataFrame([([float(v) for v in row],) for row in x], "x array<double>").repartition(5)
    found = {(r.a, r.b): r.s for r in inversions.sign_products(df, size).collect()}
    pairs = np.triu_indices(n, 1)
    signs = [np.sign(x[:, None, k] - x[None, :, k])[pairs] for k in range(4)]
    assert found == {(a, b): float(signs[a] @ signs[b]) for a in range(4) for b in range(4)}


def test_explained_variance(table):
    x, _, df = table
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    roots = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    found = selection.explained_variance(selection.correlation_matrix(df)).orderBy("component").collect()
    assert [r.share for r in found] == pytest.approx(list(roots / roots.sum()))


def test_knn_information_with_ties(table, spark):
    x, labels, df = table
    labels = np.array(labels)
    long = df.selectExpr("row_id", "label", "posexplode(x) AS (feature, value)")

    def psi(n):
        return -0.5772156649015329 + sum(1 / k for k in range(1, int(n)))

    for row in selection.knn_information(long).collect():
        v = x[:, row.feature]
        inside, total = [], 0.0
        for i in range(60):
            own = np.sort(np.abs(v[labels == labels[i]] - v[i]))[1:4][-1]
            near = np.abs(v - v[i])
            inside.append((near < own - 1e-12).sum() if own > 0 else (near == 0).sum())
        total = psi(60) + psi(3) - psi(30) - np.mean([psi(m) for m in inside])
        assert row.mi_score == pytest.approx(max(0, total), abs=1e-9)


def test_stratified_sizes(table):
    _, _, df = table
    split = classify.stratified_split(df).groupBy("label", "is_test").count().collect()
    assert {(r.label, r.is_test): r["count"] for r in split} == {
        ("A", True): 6, ("A", False): 24, ("B", True): 6, ("B", False): 24,
    }
    sample = params.stratified_sample(df, "label", "row_id", {"A": 7, "B": 40})
    assert {r.label: r["count"] for r in sample.groupBy("label").count().collect()} == {"A": 7, "B": 30}


@pytest.mark.parametrize("name", ["logistic_regression", "svm", "random_forest", "knn"])
def test_models_separate_classes(table, name):
    x, labels, df = table
    shifted = df.selectExpr("row_id", "label", "transform(x, v -> if(label = 'A', v + 3, v)) AS x")
    options = {"trees": 10} if name == "random_forest" else {}
    found, _ = classify.fit_predict(name, shifted, shifted, ("A", "B"), 4, **options)
    assert found.filter("label = prediction").count() >= 57


def test_interpolated_patterns(picture):
    rng = np.random.default_rng(2)
    img = rng.integers(0, 256, (23, 19))
    whole = texture.lbp_features(picture({"a": img}), 2, 8).first()
    cut = texture.lbp_features(recurrence.with_halo(picture({"a": img}, 7), 2), 2, 8).first()
    assert list(whole)[1:] == pytest.approx(list(cut)[1:])
    padded = np.pad(img.astype(float), 3)
    codes = []
    for r in range(23):
        for c in range(19):
            bits = []
            for k in range(8):
                y = r + 3 + round(-2 * np.sin(2 * np.pi * k / 8), 5)
                x = c + 3 + round(2 * np.cos(2 * np.pi * k / 8), 5)
                y0, x0 = int(np.floor(y)), int(np.floor(x))
                fy, fx = y - y0, x - x0
                v = sum(
                    wy * wx * padded[y0 + oy, x0 + ox]
                    for oy, wy in ((0, 1 - fy), (1, fy)) for ox, wx in ((0, 1 - fx), (1, fx)) if wy * wx
                )
                bits.append(v >= img[r, c])
            turns = sum(p != q for p, q in zip(bits, bits[1:]))
            codes.append(sum(bits) if turns <= 2 else 9)
    assert whole.lbp_mean_r2_p8 == pytest.approx(np.mean(codes))


def test_gabor_bank_on_tiles(picture):
    rng = np.random.default_rng(4)
    img = rng.integers(0, 256, (21, 26))
    tiles = recurrence.with_halo(picture({"a": img}, 8), gabor.halo_for())
    stats = gabor.response_stats(tiles, (0.2,), (45,)).first()
    y, x = np.mgrid[-3:4, -3:4]
    kernel = np.exp(-0.5 * (x**2 + y**2)) / (2 * np.pi) * np.exp(
        2j * np.pi * 0.2 * (x * np.cos(np.pi / 4) + y * np.sin(np.pi / 4))
    )
    data = np.pad(img / 255.0, 3, mode="symmetric")
    out = np.zeros(img.shape, dtype=complex)
    for a in range(7):
        for b in range(7):
            out += kernel[a, b] * data[6 - a : 6 - a + 21, 6 - b : 6 - b + 26]
    assert stats.mag_mean == pytest.approx(np.abs(out).mean())
    assert stats.phase_mean == pytest.approx(np.angle(out).mean())
    assert stats.phase_coherence == pytest.approx(abs(np.exp(1j * np.angle(out)).mean()))
    quart = gabor.magnitude_quartiles(tiles, gabor.response_stats(tiles, (0.2,), (45,)), (0.2,), (45,)).first()
    assert [quart.q25, quart.median, quart.q75] == pytest.approx(list(np.percentile(np.abs(out), [25, 50, 75])))


def test_tamura_regions_are_images_of_their_own(picture):
    rng = np.random.default_rng(8)
    img = rng.integers(0, 256, (40, 56))
    cut = tamura.regions(picture({"a": img}, 8), size=32, overlap=8, smallest=16, threshold=0)
    found = {
        (r.image_id.y, r.image_id.x): r
        for r in tamura.measures(recurrence.with_halo(cut, tamura.HALO)).collect()
    }
    spans = {"y": [(0, 32), (24, 40)], "x": [(0, 32), (24, 56)]}
    assert len(found) == 4
    for (y, x), row in found.items():
        (a, b), (c, d) = spans["y"][y], spans["x"][x]
        alone = tamura.measures(picture({"r": img[a:b, c:d]})).first()
        for name in tamura.NAMES:
            assert row[name] == pytest.approx(alone[name]), name


def test_resample_keeps_a_tone(spark):
    t = np.arange(800) / 8000
    df = spark.createDataFrame([("a", 8000, [float(v) for v in np.sin(2 * np.pi * 200 * t)])], "signal_id string, sr int, y array<double>")
    y = np.array([r.y for r in segment.resample_arrays(df, 25000).orderBy("i").collect()])
    want = np.sin(2 * np.pi * 200 * np.arange(len(y)) / 25000)
    assert len(y) == 2500 and np.abs(y - want)[200:-200].max() < 1e-3


@pytest.mark.parametrize("rate", [8000, 44100])
def test_resample_blocks_leave_no_trace(series, rate):
    rng = np.random.default_rng(3)
    sig = series({"a": rng.normal(size=500), "b": rng.normal(size=3)}).withColumn("sr", F.lit(rate))
    whole = {(r.signal_id, r.i, r.n): r.y for r in segment.resample(sig, 25000).collect()}
    assert {k[0]: k[2] for k in whole} == {"a": -(-500 * 25000 // rate), "b": -(-3 * 25000 // rate)}
    assert len(whole) == sum({k[0]: k[2] for k in whole}.values())
    for size in (16, 100):
        cut = {(r.signal_id, r.i, r.n): r.y for r in segment.resample(sig, 25000, size=size).collect()}
        assert cut.keys() == whole.keys()
        assert all(cut[k] == pytest.approx(whole[k], abs=1e-12) for k in whole)


@pytest.mark.parametrize("rate", [8000, 24999, 44100, 96000])
def test_resample_equals_the_sum_over_all_samples(series, rate):
    y = np.random.default_rng(4).normal(size=300)
    cutoff = min(1.0, 25000 / rate)
    reach = int(np.ceil(32 / cutoff))
    at = np.arange(-(-300 * 25000 // rate)) * rate / 25000
    gap = at[:, None] - np.arange(300)
    weight = cutoff * np.sinc(cutoff * gap) * (0.5 + 0.5 * np.cos(np.pi * gap / reach))
    want = np.where(np.abs(gap) < reach, weight, 0.0) @ y
    rows = segment.resample(series({"a": y}).withColumn("sr", F.lit(rate)), 25000, size=64).orderBy("i").collect()
    assert [r.i for r in rows] == list(range(len(want)))
    assert np.abs(np.array([r.y for r in rows]) - want).max() < 1e-10


@pytest.mark.parametrize("size", [8, 16, 128])
def test_halo_over_many_tiles(picture, size):
    img = np.random.default_rng(12).integers(0, 256, (128, 128))
    row = tamura.tamura_features(recurrence.with_halo(picture({"a": img}, size), tamura.HALO)).first()
    assert row.tamura_coarseness_mean == pytest.approx(tamura.tamura_features(picture({"a": img})).first().tamura_coarseness_mean)


@pytest.mark.parametrize("tile", [8, 30, 1024])
def test_large_images_are_measured_in_regions(picture, tile):
    img = np.random.default_rng(4).integers(0, 256, (64, 60))
    row = tamura.tamura_features(picture({"a": img}, tile), threshold=1000, size=32, overlap=7, smallest=8).first()
    spans = [[(k, min(k + 32, n)) for k in (0, 25, 50)[: -(-(n - 32) // 25) + 1]] for n in (64, 60)]
    alone = [
        tamura.measures(picture({"r": img[a:b, c:d]})).first().coarseness
        for a, b in spans[0] for c, d in spans[1] if min(b - a, d - c) >= 8
    ]
    assert row.tamura_coarseness_mean == pytest.approx(np.mean(alone))
    assert row.tamura_coarseness_std == pytest.approx(np.std(alone))


def test_cooccurrence_steps_are_rounded():
    assert [texture.glcm_step(a, 3) for a in texture.ANGLES] == [(0, 3), (2, 2), (3, 0), (2, -2)]
    assert [texture.glcm_step(a, 1) for a in texture.ANGLES] == [(0, 1), (1, 1), (1, 0), (1, -1)]


def test_own_delay_per_signal(series):
    rng = np.random.default_rng(9)
    sig = series({"a": rng.normal(size=50), "b": rng.normal(size=50)})
    delays = sig.sparkSession.createDataFrame([("a", 1), ("b", 3)], "signal_id string, tau int")
    mixed = {(r.signal_id, r.lag): r.value for r in params.false_neighbors(sig, 4, 3, delays=delays).collect()}
    for key, tau in (("a", 1), ("b", 3)):
        alone = params.false_neighbors(sig.filter(f"signal_id = '{key}'"), 4, tau).collect()
        assert {(r.signal_id, r.lag): r.value for r in alone} == {k: v for k, v in mixed.items() if k[0] == key}
