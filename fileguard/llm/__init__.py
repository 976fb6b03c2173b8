"""Operators of a training-data pipeline over text tables. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Tasks receive the package's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules["fileguard"])
