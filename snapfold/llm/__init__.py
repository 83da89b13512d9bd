"""Operators for large training-data pipelines, and the queries that apply them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, which therefore need no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
