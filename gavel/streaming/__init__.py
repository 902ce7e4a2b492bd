"""Structured Streaming forms of the operators."""

from pyspark import cloudpickle

import gavel

# Stateful processors travel to the Python workers by value, so a worker needs no
# copy of this package on its path.
cloudpickle.register_pickle_by_value(gavel)
