"""coverlay: how completely does one map layer cover another, measured per zone on Spark."""

import sys

from pyspark import cloudpickle

# Vectorised kernels travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
