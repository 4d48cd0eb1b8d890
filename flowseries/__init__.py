"""TCP flow recordings as Spark DataFrames: traces, flows, typed time series, bounds, charts and derived metrics."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
