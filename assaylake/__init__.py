"""Assurance analytics as Spark jobs: every operator takes DataFrames and returns DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels travel with their tasks, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
