"""vigilake: AI-activity audit as PySpark DataFrame and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few pandas functions travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
