"""Retrieval and analytics operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel by value, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
