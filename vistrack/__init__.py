"""Multi-view match and track analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value: workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
