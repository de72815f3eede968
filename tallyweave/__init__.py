"""Spark jobs that verify supplier invoices before they reach a ledger."""

import sys

from pyspark import cloudpickle

# functions travel to Python workers by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
