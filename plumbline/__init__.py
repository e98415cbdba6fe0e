"""Grounded-knowledge analytics as Spark DataFrame and streaming jobs."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors whole, so the package has to be
# installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
