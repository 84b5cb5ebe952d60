"""caseloom: a Spark-native analytics engine for large media cases and training corpora."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
