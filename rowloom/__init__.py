"""Instruction-data preparation and evaluation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in workers travel with the job, so executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
