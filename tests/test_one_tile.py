"""Images and series that lie in one tile or block are finished there; results leave a task as they come."""

import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.operators import chunks, gabor, params, recurrence, tamura, texture
from recurra.operators.blocks import map_rows
from recurra.sources.tables import signal_from_events


@pytest.fixture
def pair(picture):
    """The same images in one tile each and cut into many."""
    rng = np.random.default_rng(3)
    images = {"a": rng.integers(0, 256, (30, 30)), "flat": np.full((12, 12), 7)}
    return picture(images), recurrence.with_halo(picture(images, 8), 3)


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys): [r[c] for c in df.columns if c not in keys] for r in df.collect()}


def test_cooccurrence_of_one_tile_and_of_many(pair):
    keys = ("image_id", "distance", "angle")
    alone, cut = (rows_of(texture.glcm_props(t, distances=(1, 2)), *keys) for t in pair)
    cells = rows_of(texture.glcm_angle_props(texture.glcm_cells(pair[1], distances=(1, 2)), keys), *keys)
    assert len(alone) == 16 and alone.keys() == cut.keys() == cells.keys()
    for key, values in alone.items():
        assert values == pytest.approx(cut[key], rel=1e-12) and values == pytest.approx(cells[key], rel=1e-12)


def test_cooccurrence_moments_add_up_cells(pair):
    keys = ("image_id", "distance", "angle", "a")
    c, b = F.col("c"), F.col("b")
    sums = texture.glcm_cells(pair[1]).groupBy(*keys).agg(F.sum("c").alias("c"), F.sum(c * b).alias("cb"), F.sum(c * b * b).alias("cbb"))
    assert rows_of(texture.glcm_moments(pair[0]), *keys) == rows_of(sums, *keys) == rows_of(texture.glcm_moments(pair[1]), *keys)


def test_no_cells_leave_the_tile_of_an_image(pair):
    """One row per matrix for images in one tile: what the task emits is counted before any shuffle."""
    schema = "a int, b int, c long, n double"
    show = lambda counts: {"a": np.flatnonzero(counts), "b": 0, "c": 1}
    emitted = texture._map_counts(pair[0], schema, 256, (1,), (0, 90), show, lambda counts: {"n": float(counts.sum())})
    assert emitted.count() == 4 and emitted.filter("n is null or a is not null").count() == 0


def test_gabor_quartiles_of_one_tile_and_of_many(pair):
    keys = ("image_id", "filter")
    alone, cut = (rows_of(gabor.magnitude_quartiles(t, gabor.response_stats(t)), *keys) for t in pair)
    assert len(alone) == 24 and alone.keys() == cut.keys()
    for key, values in alone.items():
        assert values == pytest.approx(cut[key], rel=1e-9, abs=1e-12)
    assert gabor.response_stats(pair[0]).filter("median is null").count() == 0


def test_tamura_regions_of_one_tile_and_of_many(picture, monkeypatch):
    rng = np.random.default_rng(11)
    images = {"a": rng.integers(0, 256, (40, 56)), "flat": np.full((33, 20), 7), "low": np.arange(24 * 50).reshape(24, 50) % 5, "tiny": np.ones((9, 9))}
    settings = {"threshold": 0, "size": 32, "overlap": 8, "smallest": 16}
    cut = rows_of(tamura.tamura_features(picture(images, 8), **settings), "image_id")
    monkeypatch.setattr(tamura, "regions", lambda *a: pytest.fail("tiles of an image in one tile are cut and sent"))
    alone = rows_of(tamura.tamura_features(picture(images), **settings), "image_id")
    assert alone.keys() == cut.keys() == {("a",), ("flat",), ("low",)}
    for key, values in alone.items():
        assert values == pytest.approx(cut[key], rel=1e-9, abs=1e-9)


def test_information_of_one_block_and_of_many(series):
    rng = np.random.default_rng(8)
    signal = series({"a": rng.normal(size=90), "b": np.round(rng.normal(size=40)), "same": np.ones(30), "two": [1.0, 2.0]})
    one, many = (rows_of(params.mutual_information(signal, 12, size=size), "signal_id", "lag") for size in (1024, 16))
    assert one.keys() == many.keys() and len(one) == 12 * 3 + 1
    for key, (value,) in one.items():
        assert value == pytest.approx(many[key][0], abs=1e-12)


def test_results_leave_the_task_before_the_batch_ends(spark):
    live = []

    def kernel(row):
        v = np.zeros(1 << 18)
        live.append(weakref.ref(v))
        v[:] = sum(r() is not None for r in live)
        return {"v": v}

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        found = map_rows(spark.range(0, 64, 1, 1), "id", "v double", kernel)
        count, most = found.agg(F.count("v"), F.max("v")).first()
        assert count == 64 << 18 and most <= 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.fixture
def crowded(spark):
    """Events of many short series and a long one, with 64 rows for a task."""
    rows = [(k, k * 7 % 4000, k % 25 if k % 3 else 99, float(k * k % 17)) for k in range(1500)]
    events = spark.createDataFrame(rows, "event_id long, minute long, user_id long, value double")
    return events.withColumn("ts", F.timestamp_seconds(F.col("minute") * 60))


def test_tasks_grow_with_the_rows_of_the_series(spark, crowded, monkeypatch):
    def found():
        signal = signal_from_events(crowded)
        many = signal.rdd.getNumPartitions()
        signal = signal.localCheckpoint()
        mi, acf = params.mutual_information(signal, 6, size=128), params.autocorrelation(signal, 6, size=128)
        return [many, mi.rdd.getNumPartitions(), acf.rdd.getNumPartitions()], [
            rows_of(signal, "signal_id", "i"), rows_of(mi, "signal_id", "lag"), rows_of(acf, "signal_id", "lag")
        ]

    _, plain = found()
    monkeypatch.setattr(chunks, "TASK_ROWS", 64)
    tasks, dealt = found()
    assert min(tasks) == 24  # 1500 rows, 64 for a task
    for one, other in zip(plain, dealt):
        assert one.keys() == other.keys() and len(one) > 100
        for key, values in one.items():
            assert values == pytest.approx(other[key], abs=1e-12)


def test_extent_of_one_block_and_of_many(series):
    signal = series({"a": np.arange(50) % 7, "same": np.ones(30), "nan": [1.0, np.nan, 2.0], "one": [-3.0]})
    rows = {r.signal_id: (r.lo, r.hi, r.mu) for r in params.extent(signal).collect()}
    for size in (16, 64):
        for r in params.spanned_blocks(signal, size, 4, None).collect():
            assert (r.lo, r.hi, r.mu) == pytest.approx(rows[r.signal_id], nan_ok=True)
