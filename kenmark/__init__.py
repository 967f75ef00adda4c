"""Kenmark: record linkage and data preparation for device fingerprints on Spark.

The package is built on the DataFrame API. Functions that Spark ships to Python
workers are pickled by value, so executors need pyspark, pyarrow, pandas and numpy
but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
