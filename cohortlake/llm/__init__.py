"""Operators of a training-data pipeline over text tables.

Functions take and return DataFrames. The helpers that run in Python workers are shipped by value, so that
executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
