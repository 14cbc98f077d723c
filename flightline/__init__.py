"""Flight tracking analytics expressed as Spark DataFrame jobs and streams."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors inside the task, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
