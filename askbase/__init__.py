"""Operators for building and searching question/answer corpora with Spark."""

import sys

from pyspark import cloudpickle

# Arrow tasks carry this package's code with them, so executors need no
# separate installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
