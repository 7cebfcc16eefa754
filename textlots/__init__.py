"""Feedback-text analytics on Spark: lots of free text in, tables and costs out."""

import sys

from pyspark import cloudpickle

# Batch functions travel to the executors by value, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
