"""Multi-temporal raster analytics on Spark: a raster is a table of pixels."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel by value, so executors do not need
# this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
