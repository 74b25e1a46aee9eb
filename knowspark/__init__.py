"""knowspark: Spark-native analytics for a personal knowledge store."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so the workers need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from knowspark.sources.store import Store, read_store  # noqa: E402

__all__ = ["Store", "read_store"]
