"""Operators for preparing large text corpora."""

import sys

from pyspark import cloudpickle

# Tasks get these functions with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
