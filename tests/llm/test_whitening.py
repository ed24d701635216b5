import math

import numpy as np
import pytest

from recurra.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, index long, z double"


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, 1, 2.0) for i, v in rows], SCHEMA).repartition(3)
    return whitening.whiten(df, **options).collect()


def brute(rows):
    """n, x and sums in whole numbers; covariance from exact differences."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(col) for col in zip(*x)]
    gaps = [[n * a - b for a, b in zip(row, s)] for row in x]
    c = np.array(gaps, dtype=float) / n
    return n, gaps, c, c.T @ c / n


def verify(got, rows, most=32):
    n, gaps, c, cov = brute(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, len(cov))
    assert len(got) == n * k and {r.n for r in got} == {n}
    deviations = sorted((i, sum(g * g for g in row)) for (i, _), row in zip(rows, gaps))
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == deviations
    for r in got:
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-10
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    place = {i: row for row, (i, _) in enumerate(rows)}
    if len(place) == n:
        z = np.zeros((n, k))
        for r in got:
            z[place[r.vec_id], r.component - 1] = r.whitened
        want = c @ vectors[:, :k] / np.sqrt(values[:k])
        want *= np.sign((want * z).sum(axis=0))
        assert np.abs(z - want).max() < 1e-6


def test_against_numpy(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(2500, 40)) @ rng.normal(size=(40, 40)) * 0.3
    rows = [(int(i) - 100, [float(np.float32(c)) for c in v]) for i, v in enumerate(data)]
    verify(run(spark, rows), rows)


def test_blocks_and_stripes_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(300, 7)))]
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 3)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    monkeypatch.setattr(whitening, "STRIPE", 128)
    verify(run(spark, rows, most=5), rows, most=5)


def test_rows_that_take_no_part_repeats_and_null_ids(spark):
    rng = np.random.default_rng(7)
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(60, 3)))]
    good += [good[0]] * 30
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [float("inf"), 1.0, 2.0]), (94, [1.0]), (95, [])]
    verify(run(spark, good + bad), good)
    unknown = run(spark, [(None, v) for _, v in good])
    assert {r.vec_id for r in unknown} == {None} and len(unknown) == 90 * 3


def test_without_variance(spark):
    flat = run(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)])
    assert all((r.whitened is None) == (r.component > 1) for r in flat)
    assert flat[0].identity_error < 1e-9
    single = run(spark, [(1, [0.5, 0.25])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(single)] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None),
    ]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_empty(spark, rows):
    assert run(spark, rows) == []


def test_whole_table(spark):
    from recurra.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in table.collect()]
    verify(QUERIES["op12_embedding_whitening"](spark, folder).collect(), rows)


def test_huge_entries_do_not_fail(spark):
    got = run(spark, [(i, [3e38 if i == 3 else 0.5 * i, 1.0]) for i in range(10)])
    assert len(got) == 20 and all(r.deviation is None or r.deviation >= 0 for r in got)
