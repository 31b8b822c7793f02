"""Spark-native analytics over scholarly documents and training-data corpora."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry this package's code by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
