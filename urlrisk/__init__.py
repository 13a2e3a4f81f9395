"""URL-risk analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The Python workers need not have this package installed: the few functions
# that run there are sent with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
