"""Record linkage and data processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
