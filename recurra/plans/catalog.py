"""All registered queries."""

from __future__ import annotations

from . import eda_queries, filter_queries, framework_queries, image_queries, model_queries, signal_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, folder):
    return QUERIES["rqa_image"](spark, folder)


del eda_queries, filter_queries, framework_queries, image_queries, model_queries, signal_queries
