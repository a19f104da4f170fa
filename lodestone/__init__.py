"""A PySpark-native engine for hybrid retrieval and document analytics."""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
