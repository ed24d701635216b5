import numpy as np
import pytest

from recurra.llm import ann

VECTORS = "vec_id long, embedding array<float>, label int, leaf int, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, 0.0) for i, v in rows], VECTORS)


def brute_force(rows, every, k):
    kept = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in kept:
        if i % every == 0:
            scored = sorted((-(q * v).sum(), j) for j, v in kept if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def clusters(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    return [(int(i), [float(x) for x in centres[rng.integers(12)] + 0.4 * rng.normal(size=16)]) for i in range(n)]


def test_recall_and_scores(spark):
    rows = clusters(4000)
    found = ann.neighbours(table(spark, rows), every=20, k=20).collect()
    want = brute_force(rows, 20, 20)
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == set(want)
    hits = 0
    vectors = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    for i, own in by_query.items():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        for r in own:
            assert abs(r.score - float(vectors[i] @ vectors[r.vec_id])) < 1e-12
        hits += len({r.vec_id for r in own} & {j for j, _ in want[i]})
    assert hits / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("block", [16, 4096])
def test_ties_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rows = [(i, [1.0, 2.0]) for i in range(0, 70)] + [(i, [float(i % 7), 1.0]) for i in range(100, 140)]
    rows += [(200, None), (220, [0.0, 0.0]), (240, [float("nan"), 1.0]), (260, [float("inf"), 1.0]), (280, []),
             (300, [None, 1.0]), (None, [1.0, 1.0]), (320, [1.0, 2.0, 3.0]), (2**60 + 8, [1.0, 2.0])]
    found = ann.neighbours(table(spark, rows), every=20, k=5, target=1.0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_force([r for r in rows if r[0] != 320], 20, 5)
    assert got == want


def test_few_rows(spark):
    assert ann.neighbours(table(spark, [])).collect() == []
    assert ann.neighbours(table(spark, [(20, [1.0])])).collect() == []
    found = ann.neighbours(table(spark, [(20, [1.0]), (21, [3.0])])).collect()
    assert [tuple(r) for r in found] == [(20, 1, 21, 3.0)]


def test_walk_visits_every_leaf_once():
    points = np.random.default_rng(0).normal(size=(500, 8))
    tree = ann.Tree(*ann.Tree().grow(points, 10))
    seen = tree.visits(points[0], tree.leaves)
    assert sorted(seen) == list(range(tree.leaves)) and tree.leaves > 30
    assert tree.visits(points[0], 5) == seen[:5]


def test_recall_on_the_tables_own_vectors(spark, monkeypatch):
    used = []
    calibrate = ann.calibrate
    monkeypatch.setattr(ann, "calibrate", lambda filed, tree, *rest: used.append((calibrate(filed, tree, *rest), tree.leaves)) or used[-1][0])
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    table = df.collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], dtype=float)
    found = {}
    for r in ann.neighbours(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for at in np.flatnonzero(ids % 20 == 0):
        score = x @ x[at]
        score[at] = -np.inf
        hits.append(len(found[ids[at]] & set(ids[np.argsort(-score)[:20]].tolist())))
    assert np.mean(hits) >= 0.9 * 20 and {len(v) for v in found.values()} == {20}
    assert used[0][0] < used[0][1]  # not every leaf is visited


def test_every_query_finds_k_among_tiny_leaves(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, 0.5, 2.0]) for i in range(600)] + [(1000 + i, [float(c) for c in 9 * rng.normal(size=3)]) for i in range(300)]
    found = ann.neighbours(table(spark, rows), every=20, k=20).collect()
    counts = {}
    for r in found:
        counts[r.query_id] = counts.get(r.query_id, 0) + 1
    assert set(counts.values()) == {20} and len(counts) == 45
