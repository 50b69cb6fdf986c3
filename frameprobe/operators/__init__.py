"""Functions of this package go to the workers by value, so that these need not find the package."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
