"""Edit evaluation over recordings and texts, expressed as Spark table jobs."""

import sys

from pyspark import cloudpickle

# Tasks that run a Python or Arrow UDF get the function by value, so executors
# need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
