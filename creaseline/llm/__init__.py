"""Operators for preparing training text at scale, each a DataFrame -> DataFrame function."""

import sys

from pyspark import cloudpickle

# task functions travel with what they call, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
