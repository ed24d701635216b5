"""Recurrence, texture and feature analytics as Spark DataFrame transformations."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Kernels travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
