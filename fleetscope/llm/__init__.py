"""Operators for training-data pipelines: each works on DataFrames of documents or pages."""

import sys

from pyspark import cloudpickle

# Executors have no copy of this package, so its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
