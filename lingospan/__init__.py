"""lingospan: multilingual text-classification data, encoded, scored, evaluated and profiled on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
