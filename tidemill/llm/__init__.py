"""Operators of a training-data pipeline: mixing, packing, sharding, copies, filters, chat."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to the executors themselves, which need not have it.
register_pickle_by_value(sys.modules[__name__])
