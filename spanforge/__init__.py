"""Analytics over context frames, built on Spark DataFrames.

Functions that run in Python workers are shipped by value, so executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
