"""Operators for building language-model training data."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so that no executor needs an installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
