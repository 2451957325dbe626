"""siftline: analytics over captured HTTP request records, as Spark plans."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions sent to executors travel with their code, so workers need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
