"""Long series: neighbours, largest distances and gray levels without taking all pairs."""

from types import SimpleNamespace

import numpy as np
import pytest

from recurra.operators import leaves, params, recurrence


def blocks_met(y, way, dims=4, tau=2, size=100):
    """Neighbours of every block of a series that meets all blocks in one way, by pairs or by search."""
    out = {}
    for b in range(-(-len(y) // size)):
        own = params._RowBlock(SimpleNamespace(y=y[b * size : (b + 1) * size + dims * tau], n=len(y), tau=tau, b=b, signal_id="a"), dims, size)
        for lo in range(0, len(y), size):
            later = [max(0, min(size, len(y) - d * tau - lo)) for d in range(dims + 1)]
            getattr(own, way)(y[lo : lo + size + dims * tau], lo, later)
        found = own.table()
        out |= {(r.d, r.i): (r.dist, r.j, None if np.isnan(r.step) else r.step) for r in found.itertuples()}
    return out


@pytest.mark.parametrize("seed, digits, copies", [(1, 9, 1), (2, 1, 1), (3, 0, 1), (4, 2, 7), (5, -1, 3)])
def test_search_finds_the_neighbours_of_all_pairs(seed, digits, copies):
    y = np.repeat(np.round(np.random.default_rng(seed).exponential(20, 640 // copies), digits), copies)
    assert blocks_met(y, "search") == blocks_met(y, "compare")


@pytest.mark.parametrize("scale, digits, far", [(1, 9, 0), (1, 0, 0), (1e-30, 40, 0), (1e60, 0, 0), (1, 3, 1e6)])
def test_screened_neighbours_are_exact(scale, digits, far):
    rng = np.random.default_rng(8)
    y = np.round(rng.exponential(20, 900), digits) * scale + far * (np.arange(900) > 500)  # one jump: two far clusters
    for d in (2, 4, 7):
        q = np.unique(np.lib.stride_tricks.sliding_window_view(y, d), axis=0)
        p, own, number = q[:300], np.where(np.arange(300) % 3, np.arange(300), -1), rng.permutation(len(q))
        dist, best = np.full(300, np.inf), np.full(300, -1, dtype=np.int64)
        leaves.nearest(p, q, number, own, dist, best)
        root = np.sqrt(leaves.squares(p, q))
        root[np.arange(300)[own >= 0], own[own >= 0]] = np.inf
        assert np.array_equal(dist, root.min(axis=1))
        assert np.array_equal(best, np.where(root == dist[:, None], number, len(q)).min(axis=1))


@pytest.mark.parametrize("d", [2, 5, 10])
def test_most_distances_are_not_taken_exactly(monkeypatch, d):
    taken, plain = [], leaves.squares
    monkeypatch.setattr(leaves, "squares", lambda p, q: taken.append(len(p) * len(q)) or plain(p, q))
    q = np.random.default_rng(9).exponential(20, (4000, d))
    dist, best = np.full(4000, np.inf), np.full(4000, -1, dtype=np.int64)
    leaves.nearest(q, q, np.arange(4000), np.arange(4000), dist, best)
    assert (best >= 0).all() and sum(taken) < 4000 * 4000 / 100


def test_search_takes_few_of_the_pairs(monkeypatch):
    taken, plain = [], leaves.squares
    monkeypatch.setattr(leaves, "squares", lambda p, q: taken.append(len(p) * len(q)) or plain(p, q))
    y = np.random.default_rng(6).exponential(20, 8000)
    blocks_met(y, "search", dims=2, size=8000)
    assert sum(taken) < 2 * 8000 * 8000 / 10


def test_neighbours_of_blocks_of_two_sizes(series, monkeypatch):
    monkeypatch.setattr(params, "NEIGHBOR_BLOCK", 16)
    monkeypatch.setattr(params, "WIDEST", 64)
    y = np.round(np.random.default_rng(7).exponential(5, 300), 1)
    signal = series({"a": y, "b": y[:5]})
    small, whole = ({(r.signal_id, r.d, r.i): (r.dist, r.j, r.step) for r in params.nearest_neighbors(signal, 3, 2, size).collect()}
                    for size in (None, 512))
    assert small == whole and len(whole) == 300 + 298 + 296 + 5 + 3


def test_farthest_of_two_sets():
    rng = np.random.default_rng(9)
    p, q = rng.exponential(20, (3000, 3)), rng.exponential(20, (2000, 3))
    assert leaves.farthest(p, q) == max(leaves.squares(p[k : k + 500], q).max() for k in range(0, 3000, 500))


@pytest.mark.parametrize("size", [None, 64])
def test_gray_levels_of_the_image_without_the_image(series, size):
    rng = np.random.default_rng(10)
    signal = series({"a": np.repeat(np.round(rng.exponential(9, 40), 1), 7), "b": rng.normal(size=150), "flat": np.ones(20), "short": [1.0, 2.0, 3.0, 4.0]})
    image = recurrence.gray_counts(recurrence.recurrence_tiles(signal, 3, 2)).select("image_id", "v", "c")
    found = recurrence.gray_levels(signal, 3, 2, size)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, image.collect()))


def test_gray_levels_take_equal_vectors_once():
    vectors, times = leaves.repeats(np.tile([1.0, 2.0, 3.0, 5.0], 1000), 3, 2, 3000)
    assert len(vectors) == 4 and times.tolist() == [750] * 4
