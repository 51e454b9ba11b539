"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
