"""corpusflow: corpus search, reranking and text classification as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
