"""Operators for the preparation of training text. Nothing else in the library imports this subpackage.

Functions of this subpackage travel to the Python workers by value, so that executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
