"""Operators for preparing training data, and their queries."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so a worker needs no copy
# of this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
