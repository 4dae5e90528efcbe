"""Evaluate probabilistic answers at scale with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Helpers inside vectorised UDFs travel with the task, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
