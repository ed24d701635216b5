"""Registered queries against their SQL on the smallest tables, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
FAST = (
    "signal_index", "mutual_information", "choose_delay", "false_neighbors", "rp_epsilon", "rp_gray_rows",
    "rqa_image", "rqa_small_tiles", "glcm_features", "lbp_features", "stat_features", "dwt_small_tiles",
    "tamura_coarseness", "describe", "active_intervals", "preprocess_segment", "knn_information",
    "correlation_matrix", "silhouette", "knn_classifier", "gaussian_nb", "roc_points", "moving_speed",
    "smoothed_speed", "pending_images",
)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name).startswith("OK")


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_published_features(spark):
    found = entry.queries()["published_features"](spark, FOLDER)
    assert len(found.columns) == 182 and found.filter("rqa_RR > 0").count() == found.count() > 0
