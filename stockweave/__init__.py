"""Catalogue search and text preparation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from stockweave.mapping import CustomColumn, SchemaMapping

# The few functions that run in Python workers travel with the job, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["CustomColumn", "SchemaMapping"]
