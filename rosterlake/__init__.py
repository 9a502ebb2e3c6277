"""Spark-native analytics on dirty register readings.

Functions that run in Python workers are pickled by value, so executors need
PySpark, pandas, pyarrow and numpy but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
