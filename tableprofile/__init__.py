"""Profiling of a Spark DataFrame: summaries, patterns, outliers, keyword extraction."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so executors do not need
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
