"""Training-data operators: each module holds one operator with its own interface.

Functions that run on executors are shipped by value, so executors need not be
able to import this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
