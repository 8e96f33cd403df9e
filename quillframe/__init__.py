"""Quillframe: a SQL dialect for jagged records, compiled to Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions inside the tasks themselves, so a new
# or replaced executor needs no copy of the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VERSION = "0.1.0"
