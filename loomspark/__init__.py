"""loomspark: retrieval and analytics over structured text, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions go to Python workers by value: a cluster needs no copy of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
