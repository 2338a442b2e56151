"""signalmill: mine AI-agent session logs for behavioural signals, on Spark."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so that workers need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
