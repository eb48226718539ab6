"""A PySpark-native engine for counting and analysing k-mers."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors carry their code, so that the package need not be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
