"""Conversation-memory analytics on Spark DataFrames.

Python functions handed to Spark are pickled by value, so executors need only PySpark and numpy / pyarrow on their path,
not a copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
