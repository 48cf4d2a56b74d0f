"""loomseq: token-sequence preparation and analysis as Spark DataFrame jobs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the plan, so executors do not
# need this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
