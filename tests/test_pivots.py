"""Neighbours through pivots against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.operators import classify, grid, pivots, selection
from recurra.operators.pivots import pivot_search

SCHEMA = "row_id long, label string, x array<double>, own long, spare int"


def table(spark, x):
    rows = [(i, "ab"[i % 2], None if v is None else [float(c) for c in v], i, 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(x, k):
    far = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    return {(i, int(j)): far[i, j] for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), far[i]))[:k]}


@pytest.mark.parametrize("kind", ["clusters", "line", "ties", "far"])
def test_equal_to_all_distances(spark, kind):
    rng = np.random.default_rng(5)
    x = {
        "clusters": rng.normal(size=(20, 3))[rng.integers(0, 20, 400)] * 30 + rng.normal(size=(400, 3)),
        "line": rng.uniform(0, 100, (400, 1)),
        "ties": np.vstack([np.zeros((130, 2)), rng.integers(0, 6, (270, 2)).astype(float)]),  # a third are copies
        "far": np.vstack([rng.normal(size=(399, 2)), [[1e6, 1e6]]]),
    }[kind]
    rows = table(spark, x)
    found, tiles = pivot_search(rows, rows, 4, size=16, apart="own")
    got = found.collect()
    want = brute(x, 4)
    assert {(r.row_id, r.n_id) for r in got} == set(want)
    assert all(r.d == pytest.approx(want[r.row_id, r.n_id]) and r.n_label == "ab"[r.n_id % 2] for r in got)
    compared = tiles.count()
    assert tiles.distinct().count() == compared
    if kind in ("clusters", "line"):
        queries, blocks = tiles.select("q_cell", "q_part").distinct().count(), tiles.select("cell", "part").distinct().count()
        assert compared < 0.4 * queries * blocks


def test_odd_rows(spark):
    x = [[0.0], None, [float("nan")], [3.0], [float("inf")], [1.0]]
    rows = table(spark, x)
    found, _ = pivot_search(rows, rows, 5, apart="own")
    assert sorted((r.row_id, r.n_id, r.d) for r in found.collect()) == [(0, 3, 3.0), (0, 5, 1.0), (3, 0, 3.0), (3, 5, 2.0), (5, 0, 1.0), (5, 3, 2.0)]
    none, tiles = pivot_search(rows.filter("row_id < 0"), rows, 5)
    assert none.count() == 0 and tiles.count() == 0
    none, _ = pivot_search(rows, rows.filter("row_id < 0"), 5)
    assert none.count() == 0


def test_blocks_of_rows_grow_before_their_number(spark):
    """A block is copied along the other side's blocks, so copies per row stay bounded."""
    rows = spark.range(900).selectExpr("id AS row_id", "id % 2 AS label", "array(double(id % 31), double(id % 7)) AS x")
    assert grid.block_grid(rows, size=4).agg(F.max("br") + 1).first()[0] <= grid.SIDE
    x = np.array([[i % 31, i % 7] for i in range(900)], dtype=float)
    dist = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    for r in selection.silhouette_rows(rows, 4).filter("row_id % 90 = 0").collect():
        own = np.arange(900) % 2 == r.row_id % 2
        a, b = dist[r.row_id, own].sum() / (own.sum() - 1), dist[r.row_id, ~own].mean()
        assert abs(r.a - a) < 1e-9 and abs(r.b - b) < 1e-9
    train, test = rows.filter("row_id % 3 > 0"), rows.filter("row_id % 3 = 0")
    near = classify.knn_neighbors(train, test, k=2, size=4).filter("row_id % 90 = 0").collect()
    pool = np.array([i for i in range(900) if i % 3])
    for i in range(0, 900, 90):
        want = sorted((dist[i, j], j) for j in pool)[:2]
        assert sorted((r.d, r.n_id) for r in near if r.row_id == i) == want


def test_rings_of_a_cell_are_skipped(spark):
    """With one pivot all rows share a cell, and still most of its blocks are not compared."""
    x = np.random.default_rng(9).uniform(0, 100, (600, 2))
    rows = table(spark, x)
    found, tiles = pivot_search(rows, rows, 3, size=16, apart="own", pivots=1)
    want = brute(x, 3)
    assert {(r.row_id, r.n_id) for r in found.collect()} == set(want)
    assert tiles.count() == tiles.distinct().count() < 0.7 * 38 * 38
    few, _ = pivot_search(rows.filter("row_id < 590"), rows.filter("row_id >= 590"), 3, size=16, pivots=4)
    far = np.sqrt(((x[590:, None] - x[None, :590]) ** 2).sum(axis=2))
    assert {(r.row_id, r.n_id) for r in few.collect()} == {(590 + i, int(j)) for i in range(10) for j in np.argsort(far[i])[:3]}


def test_tables_that_grow_with_the_rows_are_not_sent_through_the_driver(spark, monkeypatch):
    """What may be broadcast is one row a pivot, or the chunks of an order."""
    plans, plain = [], pivots.stage

    def noted(df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df)

    monkeypatch.setattr(pivots, "stage", noted)
    rows = table(spark, np.random.default_rng(13).uniform(0, 100, (300, 2)))
    found, _ = pivot_search(rows, rows, 3, size=16, apart="own")
    assert found.count() == 900
    plans.append((found.columns, found._jdf.queryExecution().executedPlan().toString()))
    searches = [plan for columns, plan in plans if "n_id" in columns]
    tiles = [plan for columns, plan in plans if "q_part" in columns]
    assert len(searches) == len(tiles) == 2
    assert not any("Broadcast" in plan for plan in searches)
    assert tiles[0].count("BroadcastExchange") <= 2 and "Broadcast" not in tiles[1]


def test_silhouette_distances_by_product_are_those_of_pairs(monkeypatch):
    rng = np.random.default_rng(12)
    left, right = 1e4 + rng.normal(size=(300, 16)), 1e4 + rng.normal(size=(200, 16))
    right[:20], right[20:40] = left[:20], left[:20] + 1e-9  # equal and all but equal rows
    want = np.sqrt(((left[:, None] - right) ** 2).sum(axis=2))
    plain = selection.pair_by_pair
    monkeypatch.setattr(selection, "pair_by_pair", lambda *a: pytest.fail("every component of every pair"))
    got = np.concatenate([dist.copy() for _, dist in selection.distances(left, right)])
    assert np.allclose(got, want, rtol=1e-9, atol=0) and (got[np.arange(20), np.arange(20)] == 0).all()
    monkeypatch.setattr(selection, "pair_by_pair", plain)
    left[3, 2], left[200, 1], right[7, 0] = np.nan, np.inf, 1e9
    got = np.concatenate([dist.copy() for _, dist in selection.distances(left, right)])
    want = np.sqrt(((left[:, None] - right) ** 2).sum(axis=2))
    assert np.allclose(got, want, rtol=1e-9, atol=0, equal_nan=True)
    assert all((dist == 0).all() for _, dist in selection.distances(np.ones((9, 3)), np.ones((5, 3))))
