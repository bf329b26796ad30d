"""Operators for building language-model training data. Nothing else in the library imports this.

Functions of this package travel to the executors by value, so they need no installed copy there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
