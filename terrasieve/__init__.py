"""Spark-native operators for leakage-controlled tabular and spatial studies."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
