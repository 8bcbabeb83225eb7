"""Operators of a training-data pipeline over documents and embeddings.

Their Python code travels to the executors by value, so a job needs no copy of the package there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
