"""Analytics over conversation and session logs, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Python functions sent to executors travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
