"""Post-training data preparation and evaluation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to executors inside the job, so workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
