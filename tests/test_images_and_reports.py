"""Whole images over tiles, descriptor options, validation, documents and reports."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.operators import gabor, texture
from recurra.plans import descriptors
from recurra.sources import files, images, results


def whole(df, column="px", dtype=np.uint8):
    out = {}
    for row in df.collect():
        img = out.setdefault(row.image_id, np.zeros((row.h, row.w), dtype=dtype))
        img[row.r0 : row.r0 + row.nr, row.c0 : row.c0 + row.nc] = np.frombuffer(row[column], dtype=dtype).reshape(row.nr, row.nc)
    return out


def averaged(img, height, width):
    def weights(n, m):
        out = np.zeros((m, n))
        for j in range(m):
            for p in range(n):
                out[j, p] = max(0.0, min((j + 1) * n / m, p + 1) - max(j * n / m, p)) * m / n
        return out

    return weights(img.shape[0], height) @ img @ weights(img.shape[1], width).T


@pytest.mark.parametrize("size", [7, 16, 64])
@pytest.mark.parametrize("shape", [(23, 31), (41, 9), (1, 1), (17, 40)])
def test_any_factor_is_the_whole_images_average(picture, size, shape):
    img = np.random.default_rng(3).integers(0, 256, (41, 40))
    found = whole(images.area_means(picture({"a": img}, size), *shape, size=10), "v", float)["a"]
    assert found.shape == shape and np.allclose(found, averaged(img, *shape), atol=1e-9)


def test_factors_limits_and_rounding(picture):
    rng = np.random.default_rng(4)
    data = {"a": rng.integers(0, 256, (34, 51)), "b": rng.integers(0, 256, (10, 12))}
    small = whole(images.resize_tiles(picture(data, 16), factor=1.7))
    assert small["a"].shape == (20, 30) and small["b"].shape == (5, 7)
    assert (small["a"] == np.rint(averaged(data["a"], 20, 30))).all()
    fitted = whole(images.fit_tiles(picture(data, 16), largest=17))
    assert fitted["a"].shape == (11, 17) and (fitted["b"] == data["b"]).all()
    with pytest.raises(Exception, match="smaller"):
        images.area_means(picture(data, 16), 40, 10).collect()


def test_one_png_of_many_tiles(spark, picture, tmp_path):
    rng = np.random.default_rng(5)
    data = {"a": rng.integers(0, 256, (50, 33)), "b": np.zeros((16, 16)), "c": rng.integers(0, 9, (1, 70))}
    folder = f"file:{tmp_path}/png"
    paths = images.write_png(picture(data, 16), folder).collect()
    assert sorted(os.listdir(tmp_path / "png")) == ["a.png", "b.png", "c.png"] == sorted(p.path.rpartition("/")[2] for p in paths)
    back = whole(images.read_images(spark, str(tmp_path / "png"), size=1024))
    assert all((back[f"{k}.png"] == v).all() for k, v in data.items())
    with pytest.raises(Exception, match="no rows|ends at"):
        images.write_png(picture(data, 16).filter("image_id = 'a' and r0 <> 16"), folder).collect()


def test_checksums_join():
    import zlib

    parts = [b"", b"abc", bytes(70_000), b"\xff" * 9]
    adler, data = 1, b""
    for part in parts:
        adler, data = images.joined_adler(adler, zlib.adler32(part), len(part)), data + part
        assert adler == zlib.adler32(data)


def test_unfinished_files_do_not_appear(tmp_path):
    with pytest.raises(RuntimeError), files.whole_file(f"{tmp_path}/x/y.bin") as out:
        out.write(b"half")
        raise RuntimeError
    assert os.listdir(tmp_path / "x") == []


def test_problems_of_tiles(spark, picture):
    img = np.arange(30 * 20).reshape(30, 20) % 256
    tiles = picture({"good": img, "gap": img, "twice": img, "short": img, "out": img}, 8)
    first = (F.col("r0") == 8) & (F.col("c0") == 8)
    kept = tiles.filter(~((F.col("image_id") == "gap") & first))
    kept = kept.unionByName(tiles.filter((F.col("image_id") == "twice") & first))
    kept = kept.withColumn("px", F.when((F.col("image_id") == "short") & first, F.lit(b"x")).otherwise(F.col("px")))
    kept = kept.withColumn("c0", F.when((F.col("image_id") == "out") & (F.col("c0") == 16), F.lit(17)).otherwise(F.col("c0")))
    found = {r.image_id: (r.valid, r.problem) for r in images.validate_tiles(kept).collect()}
    assert found == {"good": (True, None), "gap": (False, "gaps"), "twice": (False, "pixels twice"),
                     "short": (False, "pixels missing"), "out": (False, "outside the image")}


def test_problems_of_arrays(spark):
    nan = float("nan")
    rows = [([2, 2], [1.0, 2.0, 3.0, 4.0]), ([4], [1.0] * 4), ([2, 2, 1], [1.0] * 4), ([0, 3], []), ([1, 2], [1.0, nan]), ([1, 2], [1.0, None]),
            ([2, 2], [1.0]), (None, [1.0]), ([1, 1], None), ([1, 1], [float("inf")])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, shape array<int>, px array<double>")
    got = [r.problem for r in images.validate_arrays(df).orderBy("k").collect()]
    assert got == [None, "not two-dimensional", "not two-dimensional", "empty", "not finite", "not finite", "pixels missing", "missing", "missing", "not finite"]


def test_cooccurrence_at_several_distances(picture, monkeypatch):
    monkeypatch.setattr(texture, "CELLS_HELD", 3)
    img = np.random.default_rng(6).integers(0, 4, (20, 26)) * 85
    padded = picture({"a": img})
    found = {(r.distance, r.angle, r.a, r.b): r.c for r in texture.glcm_cells(padded, 4, (1, 2, 3)).collect()}
    g = img * 3 // 255
    want = {}
    for d in (1, 2, 3):
        for angle in texture.ANGLES:
            dr, dc = round(d * math.sin(math.radians(angle))), round(d * math.cos(math.radians(angle)))
            for r in range(20):
                for c in range(26):
                    if 0 <= r + dr < 20 and 0 <= c + dc < 26:
                        key = (d, angle, g[r, c], g[r + dr, c + dc])
                        want[key] = want.get(key, 0) + 1
    assert found == want
    with pytest.raises(ValueError):
        texture.glcm_cells(padded, 4, (0,))


@pytest.mark.parametrize("points", [4, 8])
def test_patterns_by_turn_and_variance(points):
    rng = np.random.default_rng(7)
    px = rng.integers(0, 5, (14, 15)).astype(float)
    codes = texture.lbp_code_array(px, 1, points, "nri_uniform")
    plain = texture.lbp_code_array(px, 1, points, "default")
    seen = {}
    for code, bits in zip(codes.ravel(), plain.ravel()):
        seen.setdefault(int(code), set()).add(int(bits))
    last = points * (points - 1) + 2
    assert max(seen) <= last and all(len(v) == 1 for k, v in seen.items() if k != last)
    for code, patterns in seen.items():
        for p in patterns:
            b = [p >> k & 1 for k in range(points)]
            assert (sum(x != y for x, y in zip(b, b[1:])) > 2) == (code == last)
    turns = {int(texture.lbp_code_array(np.where(np.arange(9).reshape(3, 3) == 4, 1.0, (np.arange(9).reshape(3, 3) == k) * 2.0), 1, 4, "nri_uniform")[0, 0]) for k in (1, 3, 5, 7)}
    assert len(turns) == 4 and turns <= {1, 2, 3, 4}
    ring = texture.lbp_code_array(px, 1, 4, "var")
    sides = np.stack([px[1:-1, 2:], px[:-2, 1:-1], px[1:-1, :-2], px[2:, 1:-1]])
    assert (ring == np.floor(sides.var(axis=0))).all()


def test_descriptor_options(picture):
    img = np.random.default_rng(8).integers(0, 256, (24, 24))
    tiles = picture({"a": img})
    configs = {"glcm": {"distances": [1, 3], "angles": [0]}, "lbp_product": {"radii": [1, 2], "points": [4]},
               "statistical": {"moments": ["mean", "var"], "percentiles": [5, 50]}}
    assert descriptors.halo_needed(configs, configs) == 3 and descriptors.halo_needed(("glcm", "lbp")) == 1
    row = descriptors.extract(tiles, tuple(configs), configs).first().asDict()
    for name, config in configs.items():
        d = descriptors.get_descriptor(name)
        assert set(d.names({**d.config, **config})) <= set(row)
    assert row["stat_var"] == pytest.approx(img.var()) and row["stat_p5"] == pytest.approx(np.percentile(img, 5))
    assert row["stat_p50"] == pytest.approx(np.median(img)) and not {"stat_std", "stat_p10"} & set(row)
    alone = texture.glcm_features(tiles, distances=(1,), angles=(0,)).first().glcm_contrast
    far = texture.glcm_features(tiles, distances=(3,), angles=(0,)).first().glcm_contrast
    assert row["glcm_contrast"] == pytest.approx((alone + far) / 2)
    for bad in ({"frequencies": []}, {"frequencies": [0.0]}, {"sigma": 0.0}, {"orientations": [400]}):
        with pytest.raises(ValueError):
            gabor.gabor_features(tiles, **bad)
    for bad in ({"moments": ["mode"]}, {"percentiles": [101]}, {"bins": 1}):
        with pytest.raises(ValueError):
            texture.stat_features(tiles, **bad)
    with pytest.raises(ValueError):
        texture.lbp_product(tiles, (), (8,))


def test_classification_document(spark, tmp_path):
    records = [
        {"subset": s, "model_name": m, "n_train": 8, "n_test": 2, "accuracy": a, "precision": a, "recall": a, "f1_score": f, "roc_auc": None, "train_time": 1.5, "predict_time": 0.5}
        for s, m, a, f in [("top_5", "svm", 0.5, 0.4), ("top_5", "knn", 0.7, 0.6), ("all", "svm", 0.9, 0.9), ("all", "knn", 0.8, 0.9)]
    ]
    results.write_classification(spark, records, f"{tmp_path}/doc")
    back = {(r.subset, r.model_name): r for r in results.read_classification(spark, f"{tmp_path}/doc").collect()}
    assert {k for k, r in back.items() if r.is_best} == {("top_5", "knn"), ("all", "knn")}
    assert back["top_5", "svm"].f1_score == 0.4 and back["all", "svm"].roc_auc is None and back["all", "svm"].n_train == 8


def test_report_sections(spark):
    ranked = spark.createDataFrame([(2, "y", 0.1), (1, "x", 0.5)], "rank int, feature string, score double")
    summary = spark.createDataFrame([("A", 3)], "label string, rows int")
    text = results.selection_report(ranked, summary, {"alpha": 0.05}, redundant_pairs=spark.createDataFrame([("x", "z")], "a string, b string"))
    heads = [line for line in text.splitlines() if line.startswith("#")]
    assert heads == ["# Feature selection", "## Settings", "## Data", "## Selected features", "## Redundant pairs"]
    assert text.index("| 1 | x | 0.5 |") < text.index("| 2 | y | 0.1 |") and "* alpha: 0.05" in text


def test_area_means_merge_blocks_without_a_data_frame_each(picture):
    img = np.arange(40 * 40).reshape(40, 40) % 251
    found = images.area_means(picture({"a": img, "b": img.T}, 16), factor=1.7, size=8)
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.groupBy("image_id").count().filter("count = 9").count() == 2
    assert sum(np.frombuffer(r.v).sum() for r in found.filter("image_id = 'a'").collect()) == pytest.approx(img.mean() * 23 * 23)
