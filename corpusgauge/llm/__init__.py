"""Operators of a training-data pipeline: filtering, deduplication, personal
data, decontamination, mixing, archives and scoring. Nothing else in the library
imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions travel to the workers by value: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
