"""Operators of a training-data pipeline over whole document tables.

The functions that run inside tasks travel with the task by value, so the executors need
Python, numpy and pyarrow, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
