"""Operators for training-data pipelines, one module each; ``queries`` registers them over the given tables."""

import sys

from pyspark import cloudpickle

# Functions that tasks run travel by value: executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
