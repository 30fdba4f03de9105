"""Training-data operators: deduplication, filtering, sharding, tokenising and packing."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Task functions travel with the job, so executors need not have this package installed.
register_pickle_by_value(sys.modules[__name__])
