"""Transaction-risk analytics on Spark: point-in-time features, quality, drift, training and scoring."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job: workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
