"""Histogram trees against recursions written from the definitions, and both ways of growing against each other."""

import numpy as np
import pytest

from recurra.operators import trees

COLUMNS = ["fold", "tree", "heap", "feature", "threshold", "value"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(240, 5)), 1)  # few distinct values: bins are exact
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.3, size=240) > 0).astype(int)
    return x, y, np.arange(240) % 3


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, fold = data
    table = [(i, "NP"[y[i]], [float(v) for v in x[i]], int(fold[i])) for i in range(len(y))]
    return spark.createDataFrame(table, "row_id long, label string, x array<double>, fold int").repartition(4).cache()


def model_of(rows, rule, folds, **options):
    found = trees.train(rows, "P", folds, rule, **options).toPandas()[COLUMNS]
    return found.sort_values(["fold", "tree", "heap"], ignore_index=True)


def splits(x, sums, own, gain, features):
    """Best (feature, threshold, gain) over all values, ties to the first feature and smallest value."""
    best = (None, None, -np.inf)
    for j in features:
        for cut in np.unique(x[own, j])[:-1]:
            left = sums[own[x[own, j] <= cut]].sum(axis=0)
            g = gain(left, sums[own].sum(axis=0) - left)
            if g > best[2] + 1e-9 * max(1, abs(best[2])) if np.isfinite(best[2]) else g > best[2]:
                best = (j, cut, g)
    return best


def recursion(x, sums, gain, value, is_open, depth, least, features):
    out = []

    def node(own, heap, level):
        j = None
        if level < depth and is_open(sums[own].sum(axis=0)):
            j, cut, g = splits(x, sums, own, gain, features)
            j = j if g > least else None
        out.append((heap, -1 if j is None else j, None if j is None else cut, value(sums[own].sum(axis=0))))
        if j is not None:
            node(own[x[own, j] <= cut], 2 * heap, level + 1)
            node(own[x[own, j] > cut], 2 * heap + 1, level + 1)

    node(np.flatnonzero(sums[:, 2] > 0), 1, 0)
    return sorted(out)


def same(found, want):
    assert [(int(r.heap), int(r.feature)) for r in found.itertuples()] == [w[:2] for w in want]
    for r, w in zip(found.itertuples(), want):
        assert w[2] is None or r.threshold == w[2]
        assert abs(r.value - w[3]) < 1e-9


def test_impurity_tree_is_the_recursion(rows, data):
    x, y, fold = data
    rule = trees.Impurity(depth=4, min_split=12, min_leaf=5)
    found = model_of(rows, rule, [0, 1, 2])
    for f in (0, 1, 2):
        inside = fold != f
        weight = np.where(y == 1, inside.sum() / (2 * y[inside].sum()), inside.sum() / (2 * (1 - y[inside]).sum()))
        sums = np.stack([weight * (y == 0) * inside, weight * (y == 1) * inside, inside], axis=1).astype(float)

        def loss(s):
            return s[0] + s[1] - (s[0] ** 2 + s[1] ** 2) / (s[0] + s[1])

        def gain(a, b):
            return loss(a + b) - loss(a) - loss(b) if min(a[2], b[2]) >= 5 else -np.inf

        want = recursion(x, sums, gain, lambda s: s[1] / (s[0] + s[1]), lambda s: s[2] >= 12 and min(s[:2]) > 1e-9, 4, -1e-9, range(5))
        same(found[found.fold == f], want)


def test_boosting_is_the_recursion(rows, data):
    x, y, fold = data
    rule = trees.Boosting(trees=6, depth=3, rows=1.0, columns=1.0, gamma=0.05)
    found = model_of(rows, rule, [1])
    inside, margin = fold != 1, np.zeros(240)

    def cut(g):
        return np.sign(g) * max(abs(g) - 0.1, 0)

    def score(s):
        return cut(s[0]) ** 2 / (s[1] + 1)

    def gain(a, b):
        return (score(a) + score(b) - score(a + b)) / 2 - 0.05 if min(a[1], b[1]) >= 1 else -np.inf

    for k in range(6):
        p = 1 / (1 + np.exp(-margin))
        sums = np.stack([(p - y) * inside, p * (1 - p) * inside, inside], axis=1).astype(float)
        want = recursion(x, sums, gain, lambda s: -0.1 * cut(s[0]) / (s[1] + 1), lambda s: s[1] >= 2, 3, 1e-6, range(5))
        same(found[found.tree == k], want)
        known = {w[0]: w for w in want}
        for i in range(240):
            heap = 1
            while known[heap][1] >= 0:
                heap = 2 * heap + int(x[i, known[heap][1]] > known[heap][2])
            margin[i] += known[heap][3]


@pytest.mark.parametrize("rule", [
    trees.Impurity(trees=5, depth=6, min_split=5, min_leaf=2, features=2, bagged=True),
    trees.Boosting(trees=4, depth=4),
])
def test_levels_over_blocks_choose_the_same_splits(rows, monkeypatch, rule):
    monkeypatch.setattr(trees, "BLOCK_ROWS", 32)
    monkeypatch.setattr(trees, "RESTAGE", 2)
    gathered, level_wise = model_of(rows, rule, [0, 1, 2]), model_of(rows, rule, [0, 1, 2], local_bytes=0)
    ints = ["fold", "tree", "heap", "feature"]
    assert gathered[ints].equals(level_wise[ints])
    for c in ("threshold", "value"):
        assert np.allclose(gathered[c].fillna(0), level_wise[c].fillna(0), atol=1e-9)


@pytest.mark.parametrize("rule", [
    trees.Impurity(trees=5, depth=6, min_split=5, min_leaf=2, features=2, bagged=True),
    trees.Boosting(trees=4, depth=4),
])
@pytest.mark.parametrize("alone", [0, 60, 1000])
def test_subtrees_of_few_rows_are_grown_in_one_task(rows, monkeypatch, rule, alone):
    monkeypatch.setattr(trees, "BLOCK_ROWS", 32)
    monkeypatch.setattr(trees, "RESTAGE", 2)
    passes, plain = [], trees.level_cells
    monkeypatch.setattr(trees, "level_cells", lambda *a, **k: passes.append(1) or plain(*a, **k))
    gathered, found = model_of(rows, rule, [0, 1, 2]), model_of(rows, rule, [0, 1, 2], local_bytes=0, subtree_rows=alone)
    assert gathered[["fold", "tree", "heap", "feature"]].equals(found[["fold", "tree", "heap", "feature"]])
    for c in ("threshold", "value"):
        assert np.allclose(gathered[c].fillna(0), found[c].fillna(0), atol=1e-9)
    assert (not passes) if alone == 1000 else passes and len(passes) <= (rule.depth + 1) * (rule.trees if rule.boosted else 1)


@pytest.mark.parametrize("few", [240, 239])
def test_boosted_trees_of_few_rows_stay_in_their_task(rows, monkeypatch, few):
    """Rows of which one task grows a whole tree pass to it once, not once a tree."""
    monkeypatch.setattr(trees, "LOCAL_BYTES", 0)
    passes, plain = [], trees.subtrees
    monkeypatch.setattr(trees, "subtrees", lambda *a, **k: passes.append(1) or plain(*a, **k))
    found = model_of(rows, trees.Boosting(trees=3, depth=3), [0, 1, 2], subtree_rows=few)
    want = model_of(rows, trees.Boosting(trees=3, depth=3), [0, 1, 2], local_bytes=1 << 23)
    assert len(passes) == (0 if few == 240 else 3)
    assert found[["fold", "tree", "heap", "feature"]].equals(want[["fold", "tree", "heap", "feature"]])
    assert np.allclose(found.value, want.value, atol=1e-9)


def test_cells_of_shared_features():
    rng = np.random.default_rng(5)
    codes, rows, sums = rng.integers(0, 256, (900, 7), dtype=np.uint8), rng.permutation(900)[:800], rng.normal(size=(800, 3))
    at, features, sums[:, 2] = rng.integers(0, 3, 800), np.array([0, 2, 3, 6]), 1
    keys = (at[:, None] * 4 + np.arange(4)) * trees.BINS + codes[rows[:, None], features]
    for a, b in zip(trees.shared_cells(codes, rows, at, sums, features, 3), trees.cells(keys.ravel(), sums, 4)):
        assert np.array_equal(a, b)


def test_models_are_not_collected_as_rows(rows, monkeypatch):
    """The driver takes a forest in packed arrays, one row for 64 trees."""
    model = trees.train(rows, "P", [0, 1, 2], trees.Impurity(trees=100, depth=3, features=2, bagged=True))
    monkeypatch.setattr(type(model), "toPandas", None)
    shared = trees.shared_forest(model, 1)
    assert len(shared.value) == 2
    forest, want = trees.unpacked(shared.value), model.filter("fold = 1").orderBy("tree", "heap").collect()
    assert forest.trees.tolist() == list(range(100)) and forest.value.tolist() == [r.value for r in want]
    assert trees.predict(model, rows).count() == 240 and trees.predict(model.filter("fold = 1"), rows).count() == 80
    assert trees.predict(model.limit(0), rows).count() == 0


def test_a_fold_alone_has_the_same_trees(rows):
    rule = trees.Impurity(trees=8, depth=5, features=2, bagged=True)
    together, alone = model_of(rows, rule, [0, 1, 2]), model_of(rows.repartition(7), rule, [2])
    assert together[together.fold == 2].reset_index(drop=True).equals(alone)


def test_bags_are_poisson():
    weight = trees.Impurity(bagged=True).weights(np.arange(20_000)[None, :], np.arange(5)[:, None])
    assert abs(weight.mean() - 1) < 0.01 and abs(weight.var() - 1) < 0.03 and abs((weight == 0).mean() - np.exp(-1)) < 0.01


def test_predictions_and_out_of_bag(rows, data):
    x, y, fold = data
    rule = trees.Impurity(trees=60, depth=8, min_leaf=2, features=2, bagged=True)
    model = trees.train(rows, "P", [0, 1, 2], rule)
    scored = {r.row_id: r.score for r in trees.predict(model, rows).collect()}
    assert len(scored) == 240 and np.mean([(scored[i] > 0.5) == y[i] for i in scored]) > 0.8
    bag = {r.row_id: r for r in trees.out_of_bag(model, rows, rule, 0).collect()}
    assert set(bag) == set(np.flatnonzero(fold != 0).tolist())
    assert 0.25 < np.mean([r.trees / 60 for r in bag.values()]) < 0.5
    assert np.mean([(r.score > 0.5) == y[i] for i, r in bag.items() if r.trees]) > 0.8
    boosted = trees.Boosting(trees=30)
    p = trees.predict(trees.train(rows, "P", [0, 1, 2], boosted), rows, boosted=True).collect()
    assert np.mean([(r.score > 0.5) == (r.label == "P") for r in p]) > 0.8


def test_constant_features_one_class_and_many_values(spark):
    rng = np.random.default_rng(1)
    table = [(i, "P", [1.0, float(v)], i % 2) for i, v in enumerate(rng.normal(size=1000))]
    df = spark.createDataFrame(table, "row_id long, label string, x array<double>, fold int")
    edges = trees.bin_edges(df)
    assert len(edges[0]) == 0 and 200 < len(edges[1]) < 256
    counts = np.bincount(trees.coded(np.array([r[2] for r in table]), edges)[:, 1], minlength=256)
    assert counts.max() < 12
    found = model_of(df, trees.Impurity(depth=3), [0, 1])
    assert found.feature.tolist() == [-1, -1] and found.value.tolist() == [1.0, 1.0]
