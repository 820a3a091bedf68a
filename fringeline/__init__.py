"""Spark-native correlation and array analytics.

Functions that run on executors are shipped by value, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
