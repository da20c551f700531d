"""Change-impact analytics over versioned code and text, on Spark."""

import sys

from pyspark import cloudpickle

# Functions that Python workers run travel with their job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
