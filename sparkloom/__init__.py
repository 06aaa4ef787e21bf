"""Repository-style analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
