"""Spark-first analytics over code graphs, source text and findings."""

import sys

from pyspark import cloudpickle

# Functions of this library travel to the executors by value, so that no executor needs an installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
