"""Batch search and curation of large captioned catalogs on PySpark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers are pickled whole, so executors need numpy
# and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
