"""Index building, ranked search, graph and stream operators as lazy Spark DataFrame plans.

Functions that run in Python workers are sent there by value, so workers need not have the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
