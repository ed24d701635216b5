import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recurra.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """Build a long-form signal table from {id: values}."""

    def make(data):
        rows = [
            (key, i, len(values), float(y)) for key, values in data.items() for i, y in enumerate(values)
        ]
        return spark.createDataFrame(rows, "signal_id string, i long, n long, y double")

    return make


@pytest.fixture
def picture(spark):
    """Build a tile table from {id: 2-D array}."""
    import numpy as np

    from recurra.operators.recurrence import TILE_SCHEMA
    from recurra.sources.images import tile_arrays

    def make(data, size=1024):
        rows = []
        for key, img in data.items():
            columns = tile_arrays(np.asarray(img, dtype=np.uint8), size)
            for values in zip(*columns.values()):
                rows.append((key, *[v if isinstance(v, bytes) else int(v) for v in values]))
        return spark.createDataFrame(rows, "image_id string, " + TILE_SCHEMA)

    return make
