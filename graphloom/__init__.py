"""Spark-native typed-graph coarsening, with table operators around it."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
