"""rowloom: search, stitching, matching and corpus preparation as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions reach the executors by value, so that those need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
