"""A Spark-native analytics engine for large collections of scientific abstracts."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors whole, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
