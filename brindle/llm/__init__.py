"""Operators for large training-data pipelines.

Functions of this package are pickled by value, so that executors need no
installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
