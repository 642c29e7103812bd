"""Trend and anomaly analytics over time and area, written as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
