"""Palaver: a PySpark-native engine for multi-party discourse and decision data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package go to executors by value, so that workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
