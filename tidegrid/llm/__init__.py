"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the workers by value, so that executors
# need no copy of the repository on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
