"""Registered queries that cover the operator's whole range: all lags and dimensions, all models."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from recurra.operators import classify, params
from recurra.operators.blocks import signal_blocks


def test_records_look_beyond_eight_lags(spark, tmp_path):
    n = 1000
    rng = np.random.default_rng(3)
    y = np.sin(2 * np.pi * np.arange(n) / 100) + rng.normal(0, 0.01, n)
    centred = y - y.mean()
    curve = np.array([centred[: n - k] @ centred[k:] for k in range(1, 101)])
    crossing = int(np.flatnonzero(np.sign(curve[:-1]) != np.sign(curve[1:]))[0]) + 1
    start = np.datetime64("2024-01-01T00:00:00", "us")
    events = pa.table({
        "event_id": np.arange(n), "ts": start + np.arange(n) * np.timedelta64(1_000_000, "us"),
        "user_id": np.zeros(n, dtype=np.int64), "event_type": ["wave"] * n, "value": y,
    })
    pq.write_table(events, f"{tmp_path}/events.parquet")
    (record,) = entry.queries()["parameter_records"](spark, str(tmp_path)).collect()
    assert record.signal_id == "wave" and record.tau_acf == crossing > 8
    assert 1 <= record.tau_mi <= 100 and 1 <= record.dim_fnn <= 10


def test_cross_validation_covers_every_model(spark):
    rows = entry.queries()["cross_validation"](spark, "/root/testdata/sf0.001").collect()
    assert [r.model_name for r in rows] == list(classify.MODELS)
    assert all(0.3 < r.cv_f1_mean < 0.7 and 0 < r.cv_f1_std < 0.2 for r in rows)  # labels of these vectors are random


def test_model_comparison_names_one_best_of_all(spark):
    rows = entry.queries()["model_comparison"](spark, "/root/testdata/sf0.001").collect()
    subsets = {r.subset for r in rows}
    assert len(rows) == 2 * len(subsets) and {"top_5", "top_10", "all_selected"} <= subsets
    (top,) = [r for r in rows if r.is_top]
    assert top.is_best and top.f1_score == max(r.f1_score for r in rows)
    assert sorted(r.subset for r in rows if r.is_best) == sorted(subsets)


def test_series_without_a_delay_vector_give_no_row(series):
    signal = series({"short": range(54), "just": range(55)})
    assert [r.signal_id for r in params.takens(signal, 7, 9).collect()] == ["just"]
    blocks = signal_blocks(signal, after=54, points_lost=54).collect()
    assert [(r.signal_id, r.n) for r in blocks] == [("just", 55)]
