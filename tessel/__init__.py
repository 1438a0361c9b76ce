"""Columnar primitives, search-style filters and telemetry analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so that executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
