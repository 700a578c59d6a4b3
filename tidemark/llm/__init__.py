"""Operators for preparing training data; nothing else in the library imports this subpackage.

What runs inside tasks is pickled with its code, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
