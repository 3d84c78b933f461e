"""Approximate nearest-neighbour search over vectors in DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the tasks that use
# them, so a cluster needs no copy of it on every machine.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
