"""Operators of a training-data pipeline; nothing else in the library imports this package.

Each module holds one operator with its own interface, `queries` the registered queries.
"""

import sys

from pyspark import cloudpickle

# Batch functions travel with the closures that use them: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
